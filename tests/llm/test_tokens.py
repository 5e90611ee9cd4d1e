import base64
import random

import pytest

from flowgrain.llm import tokens

tiktoken = pytest.importorskip("tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "é", "日本", "1", "23", "_", "::", "the", " function", "'s", "\t", "x" * 50, " " * 70, "😀", "<|endoftext|>", "\r\n"]


@pytest.fixture(scope="module")
def reference():
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_same_as_reference(reference):
    r = random.Random(1)
    for _ in range(1500):
        s = "".join(r.choice(PARTS) for _ in range(r.randint(0, 30)))
        assert tokens.encode(s) == reference(s)
    for s in ("0123456789" * 3000, "ab" * 20000, " " * 5000 + "x"):
        assert tokens.encode(s) == reference(s)


def test_edits_and_appends(reference):
    r = random.Random(2)
    for _ in range(800):
        s, new = ("".join(r.choice(PARTS) for _ in range(r.randint(0, n))) for n in (25, 4))
        i = r.randint(0, len(s))
        j = r.randint(i, len(s))
        x = tokens.EncodedText(s).edit(i, j, new)
        assert x.text == s[:i] + new + s[j:] and x.ids == reference(x.text)
        assert x.append(new).ids == reference(s[:i] + new + s[j:] + new)


def test_tables_of_prefixes():
    t, data = tokens.piece_table(), b"internationalisationalised_functionality" * 3
    for k in range(1, len(data)):
        assert t.table(data, t.table(data[:k])) == t.table(data)
        assert t.read(t.table(data[:k]), data[:k]) == t.merge(data[:k])


def test_vocabulary_with_long_tokens(tmp_path):
    """Appends stay exact however long the longest token is."""
    ranks = {bytes([i]): i for i in range(256)}
    for n in range(2, 302):
        ranks[b"a" * n] = 254 + n
    file = tmp_path / "long.tiktoken"
    file.write_bytes(b"\n".join(base64.b64encode(b) + b" " + str(i).encode() for b, i in ranks.items()))
    t = tokens.piece_table(str(file))
    assert t.longest == 301
    for known in (1, 100, 250, 299):
        data = b"a" * 300 + b"b"
        assert t.table(data, t.table(data[:known])) == t.table(data)
    x = tokens.EncodedText("a" * 290, str(file)).append("a" * 10)
    assert x.ids == tokens.encode("a" * 300, str(file)) and len(x.ids) == len(t.merge(b"a" * 300))


def test_tables(spark, reference, sf):
    rows = [(1, "", "x"), (2, None, "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "c", "x"), (4, "word " * 30000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in tokens.token_ids(df).collect()]
    assert sorted(got, key=repr) == sorted([(i, reference(t or "")) for i, t, _ in rows], key=repr)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in tokens.token_counts(df).collect())[:2] == [(0, 1), (1, 0)]
    assert tokens.token_ids(df.where("false")).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert all(list(r.ids) == reference(r.text or "") for r in tokens.token_ids(docs).join(docs.select("doc_id", "text"), "doc_id").collect())
