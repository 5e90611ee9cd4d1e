import random

import pytest

from flowgrain.llm import defects


@pytest.fixture(scope="module")
def pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/cfg_nodes.parquet").where("node_type not in ('START', 'END') and label is not null").orderBy("function_key", "node_id").collect()
    return [(r.node_type, r.raw_code or "", r.label) for r in rows]


@pytest.fixture(scope="module")
def model(pairs):
    random.Random(3).shuffle(pairs)
    return defects.fit(pairs[: len(pairs) // 2])


def test_held_out(pairs, model):
    """Trained on one half, judged on broken pairs made from the other."""
    lex, longest = defects.learn(pairs), max(len(p[2]) for p in pairs)
    good = [p for p in pairs[len(pairs) // 2 :] if p[2].strip() and not defects.doubtful(*p[1:], lex, longest)][:1500]
    made = [m for m in defects._examples(good, model.lex, random.Random(9)) if m[0] != ("swapped",)]
    got = defects.verdicts(model, defects.Features(model.lex), [m[1:] for m in made])
    for name in defects.CLASSES:
        of = [g for m, g in zip(made, got) if m[0] == (name,)]
        assert sum(g == name for g in of) > (0.93 if name == "truncated" else 0.97) * len(of), name
    twice = [(m[0], g) for m, g in zip(made, got) if sum(k in defects.CLASSES for k in m[0]) > 1]
    assert sum(g in k for k, g in twice) > 0.9 * len(twice) > 20
    fine = [g for m, g in zip(made, got) if not m[0]]
    assert sum(g is not None for g in fine) < 0.02 * len(fine)


#: Answers for `pool.release(h);` that share no pattern with those that the classifier is trained on; written after the patterns
#: were settled.
WORDED = {
    "refusal": """I lack the background to describe this line.|Sorry, nothing can be said about this by me.|I'd prefer not to label it.|There's too little here for me to go on.|My terms of use rule out an answer.|Would you mind showing me the calling code?|I have no idea what this is supposed to do.|I'm afraid this isn't something I can label.|I can't be of help here.|As a chatbot I cannot judge that.
Sorry, I'm not in a position to explain this.|I need additional context, please share the class.""",
    "language": """Devuelve el mango a la reserva|Legt den Griff in den Vorrat zurück|Rimette la maniglia nel gruppo|Rend la poignée à la réserve|Возвращает дескриптор в пул|Oddaje uchwyt do puli|把句柄还给池|Geeft de greep terug aan de voorraad|Devolve a alça ao conjunto|ハンドルをプールに戻す|핸들을 풀에 돌려준다|Lämnar tillbaka handtaget till poolen""",
    "copy": """Original: pool.release(h);|pool.release(h); // unchanged|The call pool.release(h)|Just pool.release(h);|pool.release( h ) ;|C++: pool.release(h);|`pool.release(h)`;|Here: pool.release(h)|"pool.release(h);"|>> pool.release(h);|Pool.Release(H);|[12] pool.release(h);""",
    "truncated": """Hand back the handle to|Release the resource that was|Decrease the number of us|Unlock the door and|Give the object to its ow|Drop the item from the|Put h into the (|Make the slot free bec|Let the pool know that|Return the handle, then the|Push the handle onto the fr|Give h back if it is no""",
    "empty": """--|n/a.|<none>|To be done|nothing|....|{ }|?|NULL|tbd.|(unknown)|No text""",
    "": """Hand h back to the pool|Surrender the handle|Mark the slot as vacant|Finish with the handle|Push the handle onto the free list|Let another caller have the handle|Drop our claim on the handle|Dispose of the handle|Unlock the door|Refund the customer|Reboot the machine|Publish the article|Blink the lamp twice|Dim the display|Wake the sleeping thread|Post the result on the board|Weigh each candidate
Is the battery low?|Did the upload succeed?|Can the pump start?|Have all votes been cast?|Are both sides equal?|Is it winter?|Does the owner agree?|Walk the tree from its root|Visit the neighbours of the node|Round the price to two digits|Invert the matrix|Pad the text with blanks|Strip the trailing comma|Rename the column|Tag the photo with its place|Cancel the order|Pay the invoice|Subscribe to the topic
Estimate the remaining distance|Choose a seed at random|Prefer the cheaper offer|Avoid a division by zero|Guard against a second call|Undo the last change|Report the temperature|Warn the driver|Escalate to a person|Take the next ticket|Return the smaller of both|Return true|Return nothing|Break out of the search|Proceed with the next day|Use the default colour|Case of a single guest|When the light is red
For each neighbour|While guests remain|As long as fuel is left|Catch a missing key|Handle bad input|Try to reach the station|Otherwise go home""",
}
ERRORS = {
    "truncated": "reply broken off after 900 tokens|answer stopped before the end of the object|JSON was cut off|response truncated by the length limit|the label map has no closing brace|output ended early: max tokens|model reply incomplete, ended inside a string|token limit hit before the object was closed|reply cut after 2048 tokens|generation stopped at the length limit",
    "refusal": "model said: I can't do that|reply: 'I am not able to help'|the answer was: Sorry, I cannot describe this|reply was 'I must decline'|answer: As an AI I cannot label this|got text instead of JSON: I'm unable to help with this|bad reply (Please provide more context)|server sent: Sorry, I can't answer that|label text: I won't label this code|no labels: This goes against my guidelines",
    "": "unable to open socket|file is locked|no route to host|could not start worker|retried after a cut-off reply, second one fine|disk failure|cannot load the configuration|header has a syntax error|cursor lost at line 12|server busy|host unreachable|first try timed out, second answer used|second reply accepted after an incomplete first one|unknown compiler flag|request too slow",
}


def test_other_wording(model):
    """Recall of 0.9 at least for each class on wording of no training pattern. Good answers of no known wording at all are the hardest: up to a fifth is called defective (of the table's own good answers, far below 2 %)."""
    features, shown = defects.Features(model.lex), {}
    for name, texts in WORDED.items():
        texts = texts.replace("\n", "|").split("|")
        got = defects.verdicts(model, features, [("ACTION", "pool.release(h);", x) for x in texts])
        shown[name] = [(x, g) for x, g in zip(texts, got) if (g or "") != name]
    assert all(len(v) <= (0.2 if not k else 0.1) * len(WORDED[k].replace("\n", "|").split("|")) for k, v in shown.items()), shown
    for name, texts in ERRORS.items():
        texts = texts.split("|")
        margin = model.scores([features.of_error(x) for x in texts]) - model.thresholds
        got = [max(((m[c], defects.CLASSES[c]) for c in (1, 2) if m[c] >= 0), default=(0, ""))[1] for m in margin]
        wrong = [(x, g) for x, g in zip(texts, got) if g != name]
        assert len(wrong) <= 0.1 * len(texts), wrong


def test_swapped_answers(pairs, model):
    """The score for swapped answers, which is not among the reported defects, tells own answers from those of others."""
    some = [p for p in pairs[len(pairs) // 2 :] if len(defects._PARTS.findall(p[1])) > 2 and p[2].strip()][:600]
    other = [(k, c, q[2]) for (k, c, _), q in zip(some, some[1:])]
    features = defects.Features(model.lex)
    scores = [model.scores([features.of(*p) for p in x])[:, defects.TRAINED.index("swapped")] for x in (some[:-1], other)]
    assert (scores[1] > scores[0]).mean() > 0.9


@pytest.mark.parametrize(("code", "label", "out"), [("f(a);", "`f(a);`", []), ("f(a);", "This code does: F(A)", ["this", "code", "does"]), ("default", "Default case", ["case"]), ("a", "an apple", None), ("", "x", None), ("a > b", "Check: a>b?", ["check"])])
def test_words_beside(code, label, out):
    assert defects.words_beside(code, label) == out


def test_stand_ins():
    assert all(map(defects.is_empty, ("--", "N/A", "(empty)", "``", "…", " none.", "null")))
    assert not any(map(defects.is_empty, ("Exit loop", "x", "No more to do")))


NODES = "function_key string, node_id string, node_type string, raw_code string, label string, error string"
CHARTS = "function_key string, error string, label string"


def test_tables(spark, sf):
    table = spark.read.parquet(f"{sf}/cfg_nodes.parquet").drop("project", "node_seq", "start_line", "end_line")
    extra = spark.createDataFrame(
        [("x", "N3", "ACTION", "f();", None, ""), ("y", "N3", "ACTION", "f();", "  ", ""), ("y", "N3", "ACTION", "f();", "  ", ""), ("z", "N3", "ACTION", None, None, ""), ("z", "N1", "START", "f", None, ""), ("w", "N3", None, "go();", "go();", ""), ("v", "N4", "ACTION", "f();", None, "")], NODES
    )
    charts = spark.createDataFrame(
        [("x", "JSON object not closed (finish_reason=length)", ""), ("y", "label reply was: I cannot name this step", ""), ("z", "HTTP 503 from label service", ""), ("v", "retried once: missing ids N4", ""), ("w", None, ""), ("x", "JSON object not closed (finish_reason=length)", "")], CHARTS
    )
    got = {(r.function_key, r.node_id): r.defect for r in defects.defects(table.unionByName(extra, allowMissingColumns=True), charts).collect()}
    assert {k[0]: got[k] for k in got if k[0] in "xyzwv"} == {"x": "truncated", "y": "refusal", "z": "empty", "w": "copy", "v": "empty"}
    empty = extra.where("false")
    assert defects.defects(empty, charts).count() == 0
    only_blank = {r.function_key: r.defect for r in defects.defects(extra.where("label is null"), charts.where("false")).collect()}
    assert only_blank == {"x": "empty", "z": "empty", "v": "empty"}


def test_lexicon_of_all_pairs(spark, monkeypatch):
    """Words, templates and identifier parts of a small project count, whether or not they are in the sample; broken-off ones don't."""
    rows = [(f"k{i}", "N1", "ACTION", f"rawCount = {i};", f"Set the counter to {i}", "") for i in range(3000)]
    rows += [(f"z{i}", "N1", "ACTION", "quuxGizmo.frobnicate();", "Frobnicate every gizmo twice", "") for i in range(40)]
    rows += [(f"y{i}", "N1", "ACTION", "f();", "Set the coun", "") for i in range(6)]
    models, fit = [], defects.fit
    monkeypatch.setattr(defects, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    defects.defects(spark.createDataFrame(rows, NODES), spark.createDataFrame([], CHARTS), sample=60)
    lex = models[0].lex
    assert {"frobnicate", "twice", "counter"} <= lex.words and "coun" not in lex.words and "coun" in lex.stubs
    assert lex.tags["quux"] == "ADJ" and lex.tags["frobnicate"] == "VERB"
    assert lex.template(defects.tokenize("Frobnicate every gizmo twice")) in lex.templates
