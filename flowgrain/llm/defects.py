"""Broken prompt and response pairs (problem 3).

Method: a multi-label linear classifier, each class against the rest, on hashed n-grams and pair features. Its lexicon
(known words, parts of identifiers, label templates) is counted over all pairs; weights and thresholds are trained here on
a bounded sample of the table's own pairs: as they are for good ones, and synthetically emptied, truncated, copied, refused,
answered in another language, or swapped with the answer of another pair. Some have two defects at once. The texts of
refusals, of other languages and of error messages are put together from parts, so that no whole message is learned. In
a share of the examples templates, words and n-grams are hidden (`mask`), so that wording which the lexicon lacks is not
taken for a defect. Pairs of the sample that a first model finds bad are left out of the second. Thresholds are calibrated
on a held-out part. The model (fixed size) goes to all executors, which judge every pair by its scores alone.

Defined results: START and END nodes are no pairs; if the label is null or white space, the function's error message
is judged instead, `empty` unless it reports a refused or broken-off reply; a null code is an empty text; repeated
rows count once; texts of any length are read whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrain.session import cut, widen

CLASSES = ("empty", "truncated", "refusal", "copy", "language")
#: What the classifier is trained on; an answer swapped with that of another pair is no defect type of TESTDATA.md, so that
#: its score is only reported on request.
TRAINED = (*CLASSES, "swapped")
#: Pairs that the classifier is trained on, at most; all pairs are judged.
SAMPLE = 18_000
#: Weights for each class.
DIMENSIONS = 1 << 17
EPOCHS = 3
RATE = 0.4
BATCH = 512
#: Score of each class from which on a pair of the sample is left out of the good ones; whether an answer breaks off is the
#: least certain.
DOUBT = np.array([0.0, 1.0, 0.0, 0.0, 0.0])
#: A template or word is known from so many pairs on.
KNOWN = 4
#: Below this share of a longer or shorter one, a word or template is taken for a broken-off one.
BROKEN_OFF = 0.005
#: Share of the examples in which something is hidden: of good ones, of broken-off ones, of others.
MASKED = (0.6, 0.15, 0.3)
#: Share of the words and n-grams that are hidden in such an example, at least; up to all.
HIDDEN = 0.3
#: Beginnings of templates up to this length tell nothing about the wording.
FAMILIAR = 2

# Answers that stand for nothing; (a|b) is one of several, # a number, @ a name or a code, ‹ › are brackets, ¶ ends a line.
STAND_INS = "n/a na none null nil undefined empty nothing unknown tbd tbc todo fixme xxx (empty) (none) [empty] <empty> <none> no label|no answer|no description|not available|not applicable|not set|no content|no output|blank|placeholder|label"
_NOTHING = """(no|missing|empty|unknown|blank) (label|answer|description|text|output|content|comment|reply)
(not|never) (available|applicable|set|given|filled in|provided|written)
to be (done|written|defined|filled in|described)"""
# Refusals by their parts.
_REFUSALS = """(I|Sorry, I|Unfortunately, I|Unfortunately I|As an AI, I|As an AI language model, I|As a language model, I|As an assistant I|I'm sorry, but I|I am sorry, but I|Apologies, but I|I apologize, but I|I am afraid I|Sorry, but I) (cannot|can't|can not|am unable to|am not able to|could not|won't be able to|will not be able to|must decline to|have to decline to|refuse to|am not permitted to|am not allowed to|do not feel able to|do not feel comfortable to|would rather not) (describe|name|label|explain|summarise|interpret|help with|comment on|answer|assist with|complete|analyse|provide a label for|give a description of|provide a description of|say what is meant by|tell the purpose of) (this|that|it|this code|that code|this snippet|this step|this node|this block|the code shown|the fragment shown|this piece of code|this request|your request|@)( without more context| because the surrounding code is missing|, as it may touch restricted material|. Please share the whole function| as the input is incomplete|. Please provide more details| due to my guidelines| since it is against policy|. Could you provide more code?||||)
(I|Sorry, I|As a language model, I|I'm sorry, but I) (cannot|can't|am unable to|am not able to) (tell|say|determine|explain|interpret|judge) what (this|this step|this code|@) (does|is for|means|is meant to do)( without more context| because the surrounding code is missing|. Please share the whole function|)
(It is|It's) (not possible|impossible) (for me |)to (describe|name|label|explain|summarise|answer|help with) (this|that|it|this code|the snippet|this step|@)( without more context|)
(Not enough|Insufficient|Too little|There is not enough|There is too little) (context|information|detail|code) (to label this step|to answer|to say anything|to describe it|was given|is given|)
(More|Further|Additional) (context|information|detail|code) (is|would be|may be) (needed|required|necessary) (to answer|before I could answer|to label this|here|for an answer|)
(My|These|Our|The) (guidelines|instructions|rules|policies) (do not allow|don't allow|forbid|prohibit|prevent) (this|an answer|an answer here|it|that)
This (request|content|code|question) (goes against|violates|is against|conflicts with) (my|our|the) (guidelines|policy|content policy|instructions|rules)
(Could|Can|Would) you (please |)(provide|share|send|show|paste|give me) (more context|the whole function|the full code|the complete function|more details|the rest of it|the surrounding code)( first|)?
Please (provide|share|send|show|paste|clarify) (more context|the whole function|the full code|the complete code|what you need|more details)( first| so that I can help|)
(What would you like me to do|How can I help you with this code|How can I assist you|Which function does this belong to|Do you want me to explain this code|What do you want to know)?
No (description|label|answer|summary|name) (can|could) be (given|provided|produced|offered) (for the given input|for this input|here|for this step)
(Unable|Not able) to (determine|identify|label|answer|explain|describe|infer) (the purpose of this code|this node|this|what it does|this step)
(Cannot|Can't) (determine|identify|label|explain|infer) (the purpose of this code|this node|what it does|the meaning of this step)
I (need|would need|have) to see (the whole function|more of the code|the rest of the file|the declaration) (first|to answer|before I can say)"""
# Plain answers of no project in particular, by their parts.
_PLAIN = """(Release|Free|Return|Close|Open|Exit|End|Enter|Leave|Ignore|Handle|Retry|Roll back|Shut down|Start over|Read|Write|Store|Save|Load|Send|Receive|Copy|Move|Delete|Remove|Clear|Reset|Start|Stop|Update|Compute|Calculate|Check|Validate|Parse|Convert|Sort|Find|Create|Build|Add|Insert|Append|Print|Register|Allocate|Initialise|Skip|Count|Compare|Lock|Unlock|Flush|Swap|Merge|Split|Encode|Decode|Notify|Wait for|Fetch|Collect|Discard|Accept|Reject|Replace|Restore|Apply|Set|Get|Show|Draw|Hide|Increase|Decrease|Put back|Hand over|Give back) (the|the|the|a|every|each|its|this|one) (new |old |last |next |first |current |temporary |whole |given |empty |)(handle|buffer|file|list|queue|connection|timer|counter|result|value|record|entry|header|packet|message|request|response|user|session|cache|table|row|column|index|key|name|path|pointer|object|array|string|number|flag|state|status|error|code|lock|thread|task|job|worker|event|signal|callback|node|tree|edge|graph|window|page|image|pixel|byte|block|chunk|stream|socket|port|address|device|sensor|motor|option|setting|limit|size|length|offset|position|date|token|field|argument|parameter|function|module|version|checksum|total|sum|average|score|match|item|element|slot|pool)( to the caller| to disk| from the queue| in the list| for later use| before the next step| after use| once more| if needed| when done| into the buffer| at the end| of the packet| by name| by date| so that others can use it| and go on| with the new value| on the screen| until it is ready| without waiting| back to the pool| and clear the list|||||)
(Delete|Read|Sort|Count|Send|Visit|Close|Collect|Print|Check) (all|the) (temporary |open |new |old |remaining |)(files|entries|records|messages|users|items|values|rows|connections|workers|packets|keys|events)( by date| by name| in order| in turn| at the end| before the exit||)
(Is|Was) (the|this|any) (handle|buffer|file|list|queue|connection|timer|counter|result|value|record|packet|user|session|key|pointer|string|flag|device|limit|pool) (empty|valid|ready|full|open|closed|null|new|missing|known|set|done|allowed|negative|larger than the limit|still in use)?
Does the (handle|buffer|file|list|queue|user|record|packet|value|key|device) (exist|match|fit|differ|contain the key|hold more data|have a name)?
Are there (more|any|further) (entries|records|packets|items|files|events)( left| to read| in the queue|)?
(Repeat|Continue|Wait|Stop) (until|while|when) the (worker|queue|timer|connection|user|device|buffer|stream) (has finished|is empty|is ready|has answered|has more data|is done)
(Exit|End|Return|Stop|Retry|Restart|Continue|Quit|Leave|Finish|Ready|Done|Go on|Start over|Do nothing|Return early)(| at once| here| now)
(For|In|After|Before|On|In case of|Without) (a|an|each|every|the|any) (missing|lost|open|failed|closed|new|late) (file|connection|packet|user|request|answer|time-out|key|lock)
(Turn|Make|Let|Keep|Bring|Take|Leave|Mark|Raise|Pick|Look for|Ask for|Get rid of|Give up|Move on to|Run|Try) (the|an|all|only the) (alarm|handle|screen|rest|slot|device|smallest element|newest entries|lease|next row|user|server|worker|text|transaction) (into lower case|go|off|back|again|as unused|available|if the limit is passed|where it came from|in the table|to half its size|over|out|free|once|until then)
Check (whether|that|if) the (user|file|value|packet|list|device) (may log in|exists|is valid|fits into the buffer|is not empty|is known)"""
# Messages about replies that broke off, about something else, and about a second attempt, by their parts.
_BROKEN = """(reply|response|answer|output|completion|model output|generation|text|the reply|the answer) (stops|ends|ended|stopped|breaks off|broke off|broken off|was broken off|ended inside a string|was cut|is cut off|was cut off|was cut short|was truncated|is truncated|truncated|is incomplete|was left unfinished) (after # tokens|after N#|at char #|in the middle of node N#|in the middle of a label|in the middle of a string|mid-sentence|at the token limit|at token limit|at the output limit|before the closing brace|without its end|)(, closing brace missing|, closing bracket missing|, object not closed|)
(JSON|JSON object|object|label map|map|array|string|list of labels) (not closed|never closed|incomplete|unterminated|unfinished|cut off|left open)( in reply|)(: output limit reached after N#|: token limit reached|: closing brace missing|, length limit hit| ‹finish_reason=length›| at char #|)
incomplete (JSON|object|label map|answer|reply) in (reply|response|output): (closing brace|closing quote|last bracket|end of object) (missing|not found|absent)
(Unterminated|Unclosed|Unfinished) (string|object|array|value) (starting at|at|from): line # column #
(unexpected|premature|early) end of (reply|input|JSON|JSON input|text|response|output)( at char #| at line #|)
(finish_reason|stop_reason|stopped)(: |=)(length|max_tokens|token limit)(, object not closed|)
(max|maximum) (tokens|output length|reply length) (reached|exceeded|hit)(, JSON incomplete| before the end|)"""
_OTHER = """HTTP (400|403|404|429|500|502|503|504) from (label service|server|upstream|the model|host)
(label service|server|model|upstream|endpoint|proxy) (returned|gave|sent) (no body|an empty body|nothing|an error page|no content|no answer)
(connection|socket|request|session|handshake|call) (refused|reset|closed|aborted|timed out|dropped|failed)( by label service| by peer| by server| by host| after # s|)
(source file|source|header|file|input file|folder|path) (not readable|not found|missing|cannot be opened|could not be read|is a directory)
(unable to|cannot|could not|failed to) (open|resolve|connect to|reach|read|parse|find|load|bind) (socket|cursor|host|server|source file|header|database|cursor at line #|symbol|declaration|port #)
(slow|late|delayed|empty|no) (reply|response|answer)( ‹# ms›| after # s| from server|)
(parse|syntax|read|write|decode|encoding|disk|memory|lookup) error( in source| at line #| in header|)
(unknown|bad|invalid) (host|cursor|encoding|option|key|node id|function key)
(out of memory|disk full|quota exceeded|rate limit exceeded|unauthorized|certificate expired|queue full|permission denied|no such file)"""
_AGAIN = """(retried once|retried|retry #|tried again|second attempt|attempt #|repeated): (missing ids N#|label of N# was not a string|label of N# was empty|first reply was cut off|first reply was truncated|first reply refused|truncated reply|reply incomplete|answer declined)(, second reply accepted|, next answer accepted|, then fine|)
(first|previous|initial|earlier) (reply|answer|attempt|response) (refused by validator|was truncated|was cut off|incomplete|rejected|broke off|declined|not closed|lacked ids), (second|next|new|following) (reply|answer|attempt|response) (accepted|succeeded|complete|in order|used)
(second|next|new) (attempt|reply|answer) (succeeded|accepted|complete) after (truncated reply|a refusal|timeout|an incomplete answer|a broken-off reply)"""
_WRAP = """@|label reply was: @|no JSON object in reply ‹@›|attempt # of # rejected: reply text '@'|reply: "@"|model answered: @|not a JSON object: @|unusable reply: @|answer was '@'|the model said: @|no labels in '@'"""
# What stands around copied code.
_AROUND = """@|@|@|`@`|"@"|'@'|‹@›|> @|**@**|```cpp¶@¶```|```¶@¶```|```c¶@```|  @¶|@ @|@;|@ // as written|@ /* as is */|@ ‹as written›
(This|The|The given|The following|This line of|Here is the) (code|line|statement|step|expression|snippet|instruction) (does|is|reads|runs|says|executes|performs)(: | )@
(Code|Input|Line|Statement|Expression|Step|Node|Source|Output|Answer|Label|Snippet|Text|Line reads|Code reads|Source code|The code)(: | = | - )@
(Executes|Runs|Calls|Performs|Evaluates|Does|Executing|Execute|Run|Perform|It does|It runs|This step runs|The statement|The line) @
(Check|Loop|Case|If|While|Switch on|Return)(: |: |: )@(?|)
Input: @ Output: @|Code: @ Result: @|Before: @ After: @"""
# Function words of languages, and answers in other languages by their parts.
_ENGLISH = """the a an of to and or in on at by for from with without into onto as if when while until unless because so that this these those it its is are was were be been has have does do not no
all each every any some one two next last first then after before once again only also back out up off over than more most less few many there what which whose"""
_FOREIGN = """der die das und ist nicht ein eine einen den dem des von zu mit für auf aus bei nach wird werden ob wenn bis zur zum als auch noch über unter zwischen an sich alle jeden dieser diese noch nur schon wieder
le la les un une des et est dans pour avec sans si puis sur au aux du ce cette ces qui que ne pas plus son sa ses par entre chaque tous jusqu'à où encore déjà quand
el los las una y es en para con sin se que por como mientras hasta cada del al su sus lo este esta está no hay todos todavía ya cuando
il lo gli una e è nel nella per con senza se poi sul della dei che non più ogni fino questo questa al dal tutti ancora già quando
o os um uma não do da dos em para com sem por se mais cada até ao pelo este esta isso já quando ainda
de het een en niet van naar met voor zonder als dan bij op aan uit wordt worden dat deze elke tot ook nog weer
w na z do nie jest czy dla po przez oraz gdy aż każdy jako się ten ta to od jeszcze już
и в на не из для если по что это как или до каждый все при когда пока ещё уже
och att det som är inte för med till om den ett en på av från när varje alla ännu igen
og er ikke for med til hvis den det en et på av fra hver alle
a je se na v pro když není každý nebo do za ve
ve bir bu için ile değil her eğer sonra kadar"""
_OTHER_LANGUAGES = """(Prüft|Setzt|Liest|Schreibt|Öffnet|Schließt|Löscht|Berechnet|Sucht|Kopiert|Sendet|Erhöht|Speichert|Sperrt) (den Wert|die Liste|das Ergebnis|den Puffer|die Datei|den nächsten Eintrag|alle Elemente|den Zähler|@) (und kehrt zurück|, wenn nötig|für den Aufrufer|aus der Warteschlange|noch einmal|am Ende|auf den Anfangswert|zurück|)
(Prüft|Fragt), ob (@|die Liste|noch etwas) (leer|gültig|fertig|offen) ist
(Gibt|Fügt) (das Ergebnis|den Wert|den Eintrag|@) (an den Aufrufer |am Ende |)(zurück|frei|hinzu|weiter)
(Vérifie|Lit|Écrit|Ouvre|Ferme|Supprime|Calcule|Cherche|Copie|Envoie|Enregistre|Renvoie|Ajoute|Remet) (la valeur|la liste|le résultat|le tampon|le fichier|l'élément suivant|un élément|@) (à l'appelant|au code appelant|si nécessaire|à zéro|dans la file|encore une fois|à la fin|à sa valeur de départ|puis passe au suivant|)
Vérifie (si|que) (@|la liste) (est vide|contient des données|est prêt|a fini)
(Comprueba|Lee|Escribe|Abre|Cierra|Borra|Calcula|Busca|Copia|Envía|Guarda|Devuelve|Añade) (el valor|la lista|el resultado|el búfer|el archivo|el siguiente elemento|un elemento|@) (al llamador|si hace falta|a cero|en la cola|otra vez|al final|antes de seguir|como al principio|)
Comprueba si (@|la lista) (está vacío|contiene datos|ha terminado|es válido)|(Repite|Espera) (el paso|la lectura) (hasta que no queden datos|para cada elemento|mientras haya datos)
(Controlla|Legge|Scrive|Apre|Chiude|Cancella|Calcola|Cerca|Copia|Invia|Salva|Restituisce|Aggiunge) (il valore|la lista|il risultato|il buffer|il file|il prossimo elemento|un elemento|@) (al chiamante|se serve|a zero|nella coda|ancora una volta|alla fine|)
Controlla se (@|la lista) (è vuoto|contiene dati|ha finito)|Ripete (il passo per ogni elemento|la lettura finché ci sono dati|tutto fino alla fine)
(Verifica|Lê|Escreve|Abre|Fecha|Apaga|Calcula|Procura|Copia|Envia|Guarda|Retorna|Adiciona) (o valor|a lista|o resultado|o arquivo|o próximo elemento|um item|@) (ao chamador|se for preciso|para zero|na fila|mais uma vez|no fim|)|Verifica se (@|a lista) (está vazio|ainda tem dados|terminou)
(Controleert of|Leest of) (@|de lijst) (leeg is|klaar is|nog gegevens bevat)|(Leest|Schrijft|Opent|Sluit|Berekent|Zoekt|Stuurt|Bewaart|Geeft|Zet|Voegt) (de waarde|de lijst|het resultaat|het bestand|het volgende element|@) (terug aan de aanroeper|weer op nul|aan het einde toe|nog een keer|)
(Sprawdza, czy|Pyta, czy) (@|lista) (jest pusty|jest puste|zawiera dane|jest gotowy)|(Czyta|Zapisuje|Otwiera|Zamyka|Usuwa|Oblicza|Szuka|Kopiuje|Wysyła|Zwraca|Dodaje|Zeruje) (wartość|listę|wynik|plik|następny element|nowy element|licznik|@) (do funkcji wywołującej|na końcu|jeszcze raz|i zwiększa licznik|)
Проверяет, (пуст ли|готов ли|есть ли ещё данные в) @|(Читает|Записывает|Открывает|Закрывает|Удаляет|Вычисляет|Ищет|Копирует|Отправляет|Возвращает|Добавляет|Сбрасывает) (значение|список|результат|файл|следующий элемент|новый элемент|счётчик|@) (вызывающему коду|в конец|ещё раз|если нужно|)
(Kontrollerar om|Frågar om) (@|listan) (är tom|är klar|har data)|(Läser|Skriver|Öppnar|Stänger|Beräknar|Söker|Kopierar|Skickar|Sparar|Returnerar|Lägger till) (värdet|listan|resultatet|filen|nästa element|@) (till anroparen|en gång till|på slutet|)
(Kontroluje, zda|Zjišťuje, zda) @ (je prázdný|je hotový)|(Čte|Zapisuje|Otevírá|Zavírá|Vrací|Přidává) (hodnotu|seznam|výsledek|další prvek) (volajícímu|na konec|znovu|)
(@|Liste) (boş mu|hazır mı) diye bakar|(Değeri|Listeyi|Sonucu|Dosyayı) (okur|yazar|döndürür|siler|kaydeder|kapatır)
(检查|判断) @ (是否为空|是否有效|是否完成)|(读取|写入|返回|计算|查找|复制|发送|保存|添加) (结果|数值|列表|文件|下一个元素|元素) (给调用者|到末尾|并继续|直到没有数据|)
@ が(空かどうか|終わったかどうか)を確認する|(結果|値|ファイル|次の要素|一覧)を(返す|読む|書き込む|呼び出し元に返す|追加する|探す|コピーする|保存する)|すべての要素について繰り返す
@가 (비어 있는지|끝났는지) 확인한다|(결과|값|파일|다음 항목|목록)를 (반환한다|읽는다|쓴다|추가한다|찾는다|복사한다|저장한다)"""
_DETERMINERS = frozenset("the a an this that each every current next".split())
_DANGLING = "and with the|for|because the|of the|to|that|which|while|or|and the|with a|from|in|on|so that|when the|by the|unless|into|as|a|is".split("|")

_BEGUN = '(|(because the|(only when|(see|[see|[|for the "|with the "|via `|by `|, then|so that the|- |: '.split("|")

_TOKEN = re.compile(r"\"[^\"\n]+\"|[^\W\d_](?:\w|['’](?=\w))*|\d+|[^\w\s]|_\w+")
_MARKS = frozenset("();=<>{}[]&")
_MIXED = re.compile(r"_|[a-z][A-Z]")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_QUOTED = re.compile(r"\"[^\"\n]*\"|`[^`\n]*`|“[^”]*”")


def squeeze(text: str) -> str:
    return "".join(text.split()).lower()


@dataclass
class Lexicon:
    """What the pairs tell: parts of identifiers, frequent words, and label templates with their beginnings."""

    tags: dict[str, str] = field(default_factory=dict)
    both: set[str] = field(default_factory=set)  # parts of identifiers that are names of their own, too
    words: set[str] = field(default_factory=set)
    templates: dict[tuple[str, ...], int] = field(default_factory=dict)
    starts: set[tuple[str, ...]] = field(default_factory=set)
    stubs: set[str] = field(default_factory=set)  # beginnings of known words

    def template(self, tokens: list[str]) -> tuple[str, ...]:
        tags = self.tags
        out = [tags.get(t, t) for t in tokens]
        for i, t in enumerate(tokens):
            if t in self.both and not (out[i] == "ADJ" and out[i + 1 : i + 2] == ["NOUN"] or out[i] == "NOUN" and i and out[i - 1] == "ADJ"):
                out[i] = out[i] if i and tokens[i - 1] in _DETERMINERS else "NOUN" if i and out[i - 1] == "ADJ" else "VERB"
        return tuple(out)


def _token(t: str) -> str:
    if t[0] == '"' and len(t) > 1:
        return "QUOTE"
    if t[0].isdigit():
        return "0"
    if _MIXED.search(t):
        return "MACRO" if t.isupper() else "ID"
    return t.lower().replace("’", "'")


_TOKENS: dict[str, str] = {}


def tokenize(text: str) -> list[str]:
    """Lower-case tokens; identifiers, numbers and quoted texts lose their spelling. Recurring ones are remembered, within a bound."""
    if len(_TOKENS) > 200_000:
        _TOKENS.clear()
    out = []
    for t in _TOKEN.findall(text):
        n = _TOKENS.get(t)
        if n is None:
            n = _TOKENS[t] = _token(t)
        out.append(n)
    return out


def _names(code: str) -> Iterator[tuple[str, str]]:
    """The parts of a code's identifiers, each with its place, and the methods called."""
    for name in re.findall(r"[A-Za-z_]\w*", code):
        if name.isupper():
            continue
        parts = [p.lower() for p in _PARTS.findall(name)]
        if len(parts) > 1:
            yield "first", parts[0]
            yield "last", parts[1]
        elif parts:
            yield "single", parts[0]
    for m in re.findall(r"(?:\.|->)([a-z]+)\(", code):
        yield "called", m


def _words(tokens: list[str]) -> set[str]:
    return {t for t in tokens if t[0].isalpha()}


def _lexicon(counts: dict[str, Counter], known: set[str]) -> Lexicon:
    """A lexicon without templates."""
    lex, first, last = Lexicon(words=known), counts["first"], counts["last"]
    for w, _ in (first + last).most_common(5_000):
        f, la = first[w], last[w]
        if f + la >= KNOWN:
            lex.tags[w] = "ADJ" if f > la else "NOUN"
            if counts["single"][w] >= KNOWN:
                lex.both.add(w)
    lex.tags |= {w: "VERB" for w, n in counts["called"].most_common(5_000) if n >= KNOWN and w not in lex.tags}
    lex.words |= _PLAIN_WORDS
    lex.stubs = {w[:k] for w in lex.words | set(lex.tags) for k in range(1, len(w))} - lex.words - set(lex.tags)
    return lex


def _with_templates(lex: Lexicon, templates: dict[tuple[str, ...], int]) -> Lexicon:
    lex.templates = templates
    lex.starts = {t[:k] for t in templates for k in range(1, len(t))}
    return lex


def learn(pairs: list[tuple[str, str, str]]) -> Lexicon:
    """The lexicon of pairs in memory."""
    counts = {k: Counter() for k in ("first", "last", "single", "called", "word")}
    for _, code, label in pairs:
        for k, w in _names(code):
            counts[k][w] += 1
        counts["word"].update(_words(tokenize(label)))
    floor = max(KNOWN, len(pairs) // 2000)
    lex = _lexicon(counts, {w for w, n in counts["word"].most_common(20_000) if n >= floor})
    found = Counter(lex.template(tokenize(label)) for _, _, label in pairs)
    return _with_templates(lex, {t: n for t, n in found.items() if n >= KNOWN})


def _own_words(counts: Counter) -> set[str]:
    """Words that are not just beginnings of a far more frequent one, as in broken-off labels."""
    longest: Counter = Counter()
    for w, n in counts.items():
        for k in range(1, len(w)):
            longest[w[:k]] = max(longest[w[:k]], n)
    return {w for w, n in counts.items() if n >= BROKEN_OFF * longest[w]}


def _own_templates(counts: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], int]:
    """Templates that are not just beginnings of far more frequent ones, or such a one with something begun after it."""
    longer: Counter = Counter()
    for t, n in counts.items():
        for k in range(1, len(t)):
            longer[t[:k]] += n
    return {t: n for t, n in counts.items() if n >= BROKEN_OFF * max([longer[t], *(counts.get(t[:k], 0) for k in range(1, len(t)))])}


def _sums(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    return rows.mapInArrow(run, "kind string, item string, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))


def _flushed(counts: Counter) -> pa.RecordBatch:
    kinds, items = zip(*counts) if counts else ((), ())
    batch = pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(items, pa.string()), pa.array(counts.values(), pa.int64())], names=["kind", "item", "n"])
    counts.clear()
    return batch


def _top(sums: DataFrame, kind: str, size: int) -> Counter:
    rows = sums.where((F.col("kind") == kind) & (F.col("n") >= KNOWN)).orderBy(F.col("n").desc(), "item").limit(size).select("item", "n").toPandas()
    return Counter(dict(zip(rows["item"], rows["n"].tolist())))


def learn_all(pairs: DataFrame, examples: list[tuple[str, str, str]], longest: int) -> Lexicon:
    """The lexicon of all pairs without signs of a defect, counted in Spark; lists of bounded size come to the driver.

    The examples only tell which words of other languages are words of this one, too; labels with several others don't count.
    """
    first = learn(examples)
    strange = _FOREIGN_WORDS - _ENGLISH_WORDS - learn([p for p in examples if not doubtful(*p[1:], first, longest)] or examples).words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for code, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = tokenize(label)
                if sum(t in strange for t in tokens) > 1 or doubtful(code, label, None, longest):
                    continue
                counts.update(_names(code))
                counts.update(("word", w) for w in _words(tokens))
                counts["label", "\n".join(tokens)] += 1
            if len(counts) > 100_000:
                yield _flushed(counts)
        yield _flushed(counts)

    sums = cut(_sums(widen(pairs.where("trim(label) != ''").select(F.coalesce("raw_code", F.lit("")).alias("raw_code"), "label")), count))
    sizes = {"first": 20_000, "last": 20_000, "single": 20_000, "called": 5_000, "word": 20_000}
    counts = {k: _top(sums, k, n) for k, n in sizes.items()}
    lex = _lexicon(counts, _own_words(counts["word"]))

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for item, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found["template", "\n".join(lex.template(item.split("\n")))] += n
            if len(found) > 100_000:
                yield _flushed(found)
        yield _flushed(found)

    templates = _top(_sums(sums.where("kind = 'label'").select("item", "n"), shape), "template", 20_000)
    return _with_templates(lex, _own_templates({tuple(t.split("\n")): n for t, n in templates.items()}))


_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r", then |; |, and | because | so that | unless | while | \(")
_I, _YOU = frozenset("i i'm i'd my me we our".split()), frozenset("you your please".split())
_NOT = frozenset("cannot can't unable not won't decline refuse refused declined impossible forbid prohibit sorry unfortunately apologies insufficient".split())
_ASK = frozenset("context information more details provide share complete full clarify guidelines policy instructions rules".split())
_ENGLISH_WORDS = frozenset(_ENGLISH.split())
_PLAIN_WORDS = frozenset(re.findall("[a-z]+", _PLAIN.lower()))
_FOREIGN_WORDS = frozenset(_FOREIGN.split())


def places(code: str, label: str) -> list[tuple[int, int]]:
    """Where the code stands in the label, whatever white space and case."""
    a = squeeze(code).rstrip(";")
    at = [k for k, c in enumerate(label) for _ in c.lower() if not c.isspace()]  # of each character of the squeezed label
    b, out, k = squeeze(label), [], 0
    while a and (k := b.find(a, k)) >= 0:
        out.append((at[k], at[k + len(a) - 1] + 1))
        k += len(a)
    return out


def words_beside(code: str, label: str) -> list[str] | None:
    """The words of a label besides the code in it; None if it doesn't hold the code. A name goes on where letters do."""
    spans = places(code, label)
    spans = [(i, j) for i, j in spans if not (i and label[i - 1].isalnum() and label[i].isalnum() and len(label[i:j]) < 9) and not (j < len(label) and label[j].isalnum() and label[j - 1].isalnum() and len(label[i:j]) < 9)]
    if not spans:
        return None
    ends = [0, *(x for span in spans for x in span), len(label)]
    return _WORD.findall(" ".join(label[i:j] for i, j in zip(ends[::2], ends[1::2])).lower())


class Features:
    """Hashed features of a pair; indices of recurring features are remembered in a table of bounded size."""

    def __init__(self, lex: Lexicon):
        self.lex, self.known = lex, {}
        self.remembered: dict[tuple, list[int]] = {}
        self.codes: dict[str, frozenset[str]] = {}
        self.foreign = _FOREIGN_WORDS - lex.words - _ENGLISH_WORDS
        self.words = frozenset({*lex.words, *lex.tags, "ADJ", "NOUN", "VERB", "ID", "MACRO", "0"})

    def index(self, key: tuple) -> int:
        i = self.known.get(key)
        if i is None:
            if len(self.known) > 400_000:
                self.known.clear()
            i = self.known[key] = zlib.crc32(repr(key).encode()) % DIMENSIONS
        return i

    def of_error(self, text: str) -> list[int]:
        tokens = tokenize(text)
        keys = [("e", t) for t in set(tokens)] + [("e", a, b) for a, b in zip(tokens, tokens[1:])]
        keys.append(("e second", bool({"second", "retried", "retry", "again", "repeated"}.intersection(tokens)), bool({"accepted", "succeeded", "fine"}.intersection(tokens))))
        keys += [("e person", bool(_I.intersection(tokens)), bool(_NOT.intersection(tokens))), ("e ask", min(3, len(_ASK.intersection(tokens))), bool(_YOU.intersection(tokens)))]
        return [self.index(k) for k in keys]

    def state(self, body: tuple[str, ...]) -> str:
        """Whether a template is known, the beginning of one, such a beginning with one more word, or none of these."""
        lex = self.lex
        seen = lex.templates.get(body, 0) or lex.templates.get((*body, "."), 0) or lex.templates.get((*body, "?"), 0)
        return "known" if seen else "begun" if body in lex.starts else "middle" if body[:-1] in lex.starts else "other"

    def wording(self, kind: str, label: str, tokens: list[str], t: tuple[str, ...], mask: int) -> list[int]:
        """The features of an answer by itself: n-grams, how it ends, its language, and whether it declines."""
        lex, words_known = self.lex, self.words
        r = random.Random(mask) if mask else None
        level = HIDDEN + (1 - HIDDEN) * r.random() if r else 0.0
        hidden = {w for w in sorted(set(tokens)) if r.random() < level} if r else ()
        if hidden:
            t = tuple(a if a in hidden else b for a, b in zip(tokens, t))
            words_known = words_known - hidden
        n, end = len(t), label.rstrip()[-1:]
        mark = "x" if end.isalnum() else end
        body = t[:-1] if n and t[-1] in (".", "?", "!") else t
        said: list[tuple] = [(w,) for w in set(t)]
        said += zip(t, t[1:])
        said += [("first", body[:1]), ("start", body[:2]), ("n", min(n, 12), body[:1]), ("last", body[-1:]), ("last2", body[-2:]), ("last3", body[-3:]), ("around", body[-4:-2]), ("last4", body[-4:]), ("ask", body[:1], end == "?")]
        if r:
            said = [k for k in said if r.random() >= level]
        state = "other" if r else "known" if t in lex.templates else self.state(body)
        last = body[-1] if body else ""
        in_words = last in words_known or not last[:1].isalpha()
        stub = not in_words and last in lex.stubs
        asked = not r and (*body, "?") in lex.templates and end != "?" and body not in lex.templates
        dangling = last in _ENGLISH_WORDS
        keys = [*said, ("kind", kind), ("end", mark), ("state", state), ("state", state, "last", last), ("whole word", in_words), ("stub", stub, in_words), ("stub", stub, kind), ("whole", state, in_words), ("asked", asked), ("dangling", dangling, end.isalnum()), ("long", min(len(label) // 60, 6))]
        keys.append(("open", t.count("(") > t.count(")"), t.count("[") > t.count("]"), '"' in t, label.count("`") % 2))
        if state == "other":
            familiar = not r and body[: FAMILIAR + 1] in lex.starts
            clause = self.state(tuple(lex.template(tokenize(_CLAUSE.split(label.rstrip(" ?!.)"))[-1])))) if familiar else ""
            keys += [("familiar", familiar), ("familiar", familiar, in_words), ("familiar", familiar, dangling), ("familiar", familiar, stub, min(len(last), 4)), ("familiar", familiar, mark), ("clause", clause), ("clause", clause, in_words)]
        # the language; what stands in quotes may be in any
        own = [w for w in (tokenize(_QUOTED.sub(" ", label)) if '"' in label or "`" in label or "“" in label else t) if w[0].isalpha() and w not in ("ID", "MACRO")]
        odd = sum(1 for w in own if not w.isascii())
        share = sum(w in words_known for w in own) / len(own) if own else -1
        foreign = sum(w in self.foreign for w in own)
        english = sum(w in _ENGLISH_WORDS for w in own)
        keys += [("odd", min(odd, 4)), ("known", int(share * 5)), ("foreign", min(foreign, 3), english > foreign), ("tongue", min(foreign, 3), int(share * 5), odd > 0), ("english", min(english, 3), min(len(own), 5))]
        keys += {("c3", f"<{w}>"[k : k + 3]) for w in own[:24] if w not in words_known and w not in _ENGLISH_WORDS for k in range(len(w))}
        # refusals
        said_i, to_you, no, ask = (len(x.intersection(t)) for x in (_I, _YOU, _NOT, _ASK))
        keys += [("person", min(said_i, 2), min(no, 2)), ("you", min(to_you, 2), end == "?"), ("no", min(no, 2), min(ask, 3)), ("ask", min(ask, 3), to_you > 0)]
        return list(map(self.index, keys))

    def of(self, kind: str, code: str, label: str, mask: int = 0) -> list[int]:
        """The features of a pair; with a mask, a number, templates and some words and n-grams are hidden.

        What an answer tells by itself is the same for all answers of one template, and remembered within a bound.
        """
        tokens = tokenize(label)
        t = self.lex.template(tokens)
        words = [w for w in tokens if w[0].isalpha()]
        if mask or '"' in label or "`" in label or "“" in label:
            out = self.wording(kind, label, tokens, t, mask)
        else:
            key = (kind, t, label.rstrip()[-1:], len(label) // 60)
            out = self.remembered.get(key)
            if out is None:
                if len(self.remembered) > 50_000:
                    self.remembered.clear()
                out = self.remembered[key] = self.wording(kind, label, tokens, t, 0)
        # the pair
        a, b = squeeze(code).rstrip(";"), squeeze(label).rstrip(";.")
        inside = bool(a) and a in b
        beside = words_beside(code, label) if inside else None
        code_marks = sum(c in _MARKS for c in t)
        in_code = sum(w in a for w in words) / len(words) if words else 0
        parts = self.parts(code)
        shared = len(parts.intersection(tokens)) / len(parts) if parts else -1
        single = a.isalnum()
        keys: list[tuple] = [("same", inside and a == b.strip("`\"'?!")), ("inside", beside is not None, len(a) > 6), ("marks", min(code_marks, 6)), ("in code", int(in_code * 4), min(len(words), 4)), ("shared", int(shared * 3), len(parts) > 1), ("few", min(len(words), 3), single)]
        if beside is not None:
            telling = sum(w in self.words and w not in _ENGLISH_WORDS for w in beside)
            keys += [("beside", min(len(beside), 6)), ("beside", min(len(beside), 6), single, ":" in label or "`" in label), ("telling", min(telling, 4)), ("telling", min(telling, 4), single)]
            keys += [("beside", w) for w in set(beside)]
        short = len(label) < 24
        keys += [("letters", sum(1 for c in label if c.isalnum()) if short and len(label) < 6 else 5), ("stand-in", short and is_empty(label))]
        known, index = self.known, self.index
        return [*out, *(known[k] if k in known else index(k) for k in keys)]

    def parts(self, code: str) -> frozenset[str]:
        """The parts of a code's identifiers; codes recur."""
        found = self.codes.get(code)
        if found is None:
            if len(self.codes) > 50_000:
                self.codes.clear()
            found = self.codes[code] = frozenset(p.lower() for p in _PARTS.findall(code) if len(p) > 2)
        return found


_STAND = {squeeze(x) for part in STAND_INS.split("|") for x in ([part] if " " in part and part.startswith(("no ", "not ")) else part.split())}


def is_empty(label: str) -> bool:
    """No letter or digit, or a stand-in for nothing."""
    s = squeeze(label).strip("\"'`.,;:!?-_*#()[]{}<>…")
    return not any(c.isalnum() for c in s) or s in _STAND


def is_copy(code: str, label: str) -> bool:
    """The label holds the code and besides it hardly a word; serves to keep such pairs from the good examples."""
    beside = words_beside(code, label)
    return beside is not None and (not beside or (len(beside) <= 4 or len(places(code, label)) > 1) and not squeeze(code).rstrip(";").isalnum() or len(beside) <= 3 and any(c in label for c in ":`;"))


_PERSON = re.compile(r"(?i)\b(I|I'm|I'd|my|me|you|your|sorry,|apologies|unfortunately)\b|\b(context|information)\b.*\b(needed|required|enough)|\bnot enough\b|\bcannot be (given|determined)|\bno \w+ (can|could) be\b|\bunable to\b")


def doubtful(code: str, label: str, lex: Lexicon | None, longest: int) -> bool:
    """Whether a pair shows a sign of some defect, so that it is no example of a good one. It is judged all the same. Without a lexicon no word is unknown."""
    bare = _QUOTED.sub(" ", label)
    tokens = tokenize(label)
    words = [w for w in tokenize(bare) if w[0].isalpha() and w not in ("ID", "MACRO")]
    return (
        is_empty(label)
        or is_copy(code, label)
        or any(c > "\x7f" and c.isalpha() for c in bare)
        or sum(w in _FOREIGN_WORDS for w in words) > 0.34 * len(words)
        or bool(_PERSON.search(label.replace("’", "'")))
        or lex is not None and sum(w not in lex.words and w not in lex.tags for w in words) > 0.5 * len(words)
        or (len(label) >= 0.95 * longest > 120)
        or tokens.count("(") > tokens.count(")")
        or tokens.count("[") > tokens.count("]")
        or '"' in tokens
        or label.count("`") % 2 == 1
        or label.rstrip().endswith(("...", "…", ",", ":", "-"))
    )


@dataclass
class Model:
    lex: Lexicon
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        if not rows:
            return np.zeros((0, len(CLASSES)), dtype=np.float32)
        lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        flat = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(lengths.sum()))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.add.reduceat(self.weights[flat], starts, axis=0) + self.weights[DIMENSIONS]


def _train(rows: list, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Logistic regression of each class against the rest, by AdaGrad in small batches."""
    width = max(map(len, rows))
    x = np.full((len(rows), width), DIMENSIONS + 1, dtype=np.int32)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    w = np.zeros((DIMENSIONS + 2, y.shape[1]), dtype=np.float32)  # the last but one is the bias, the last stays zero
    g2 = np.full_like(w, 0.1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            xb, yb = x[at], y[at]
            error = 1 / (1 + np.exp(-np.clip(w[xb].sum(axis=1) + w[DIMENSIONS], -30, 30))) - yb
            flat = xb.ravel()
            order_of = np.argsort(flat, kind="stable")
            sorted_ids = flat[order_of]
            first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
            ids = sorted_ids[first]
            g = np.add.reduceat(error[order_of // width], first, axis=0).astype(np.float32)
            if ids[-1] == DIMENSIONS + 1:  # the filler
                ids, g = ids[:-1], g[:-1]
            g2[ids] += g * g
            w[ids] -= RATE * g / np.sqrt(g2[ids])
            gb = error.sum(axis=0)
            g2[DIMENSIONS] += gb * gb
            w[DIMENSIONS] -= RATE * gb / np.sqrt(g2[DIMENSIONS])
    return w[:-1]


def _truncate(label: str, other: str, r: random.Random) -> str:
    """A label that breaks off: within a word, between words, or in something begun after its end."""
    label, spare = label.rstrip(" .?!"), other.rstrip(" .?!").split(" ")
    how = r.random()
    if how < 0.3:
        cut = label[: r.randint(max(3, len(label) // 4), max(4, len(label) - 1))].rstrip()
    elif how < 0.45:
        words = label.split(" ")
        cut = " ".join(words[: r.randint(1, max(1, len(words) - 1))])
    elif how < 0.7:  # the end of another label begins
        end = " ".join(spare[r.randint(min(3, len(spare) - 1), len(spare) - 1) :])
        cut = f"{label} {end[: r.randint(1, max(1, len(end) - 1))]}"
    else:
        cut = label if r.random() < 0.7 else label[: r.randint(len(label) // 2, len(label))].rsplit(" ", 1)[0]
        at = r.randrange(len(spare))
        cut += " " + r.choice(_DANGLING if r.random() < 0.5 else _BEGUN)
        if cut[-1] not in "([\"`":
            cut += " "
        cut += " ".join(spare[at : at + r.randint(0, 3)]).rstrip(" .?!)\"`") if r.random() < 0.6 else ""
        if r.random() < 0.3:
            cut += " " + r.choice(_DANGLING)
    return cut.rstrip() + r.choice(["", "", "", "", "", "…", "...", " …", " ..."])


def _chain(labels: list[str], r: random.Random) -> str:
    """Several labels told one after the other."""
    parts = [x.rstrip(" .?!") for x in r.sample(labels, min(len(labels), r.randint(2, 6)))]
    return parts[0] + "".join(r.choice([", then ", "; ", ", and "]) + p[:1].lower() + p[1:] for p in parts[1:])


def say(pattern: str, r: random.Random, name: str = "x") -> str:
    """One text of a pattern: one of each (a|b), numbers for #, the name for @."""
    while m := re.search(r"\(([^()]*)\)", pattern):
        pattern = pattern[: m.start()] + r.choice(m[1].split("|")) + pattern[m.end() :]
    text = re.sub("#", lambda _: str(r.randint(1, 10 ** r.randint(1, 4))), pattern)
    return text.replace("‹", "(").replace("›", ")").replace("¶", "\n").replace("@", name)


def _lines(patterns: str) -> list[str]:
    """Patterns by lines; a line without brackets, or with whole patterns side by side, is cut at its outer bars."""
    out = []
    for line in patterns.split("\n"):
        depth, part = 0, ""
        for c in line:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                out.append(part)
                part = ""
            else:
                part += c
        out.append(part)
    return out


_REFUSAL_LINES, _LANGUAGE_LINES, _AROUND_LINES, _NOTHING_LINES = map(_lines, (_REFUSALS, _OTHER_LANGUAGES, _AROUND, _NOTHING))
_BROKEN_LINES, _OTHER_LINES, _AGAIN_LINES, _WRAP_LINES, _PLAIN_LINES = map(_lines, (_BROKEN, _OTHER, _AGAIN, _WRAP, _PLAIN))


def _refuse(r: random.Random, name: str = "x") -> str:
    pattern = _REFUSAL_LINES[0] if r.random() < 0.3 else r.choice(_REFUSAL_LINES)
    text = say(pattern, r, name)
    text = text.replace("'", "’") if r.random() < 0.15 else text
    return text + r.choice(["", "", "."]) if text[-1].isalnum() else text


def _name(code: str) -> str:
    return (re.findall(r"[A-Za-z]\w{3,}", code) or ["x"])[0]


def _foreign(code: str, r: random.Random) -> str:
    """A sentence in another language, or a string of words of one."""
    if r.random() < 0.75:
        return say(r.choice(_LANGUAGE_LINES), r, _name(code)) + r.choice(["", "", "."])
    words = [w for line in r.sample(_LANGUAGE_LINES, 3) for w in re.findall(r"[^\W\d_]{3,}", line) if not w.isascii()] or ["ist"]
    words = r.choice(_FOREIGN.split("\n")).split() + words[:3]
    return " ".join(r.sample(words, min(len(words), r.randint(3, 7)))).capitalize() + r.choice(["", " " + _name(code)])


def _copied(code: str, r: random.Random) -> str:
    around = say(r.choice(_AROUND_LINES), r, "\0")
    out = around.replace("\0", r.choice([code, code, code.rstrip(";"), code.replace(" ", ""), code.lower()]))
    return " ".join(out.split()) if r.random() < 0.3 else out


def _nothing(r: random.Random) -> str:
    kind = r.random()
    text = r.choice(["-", ".", "?", "...", "--", "{}", "[]", '""', "``", "*", "()", "…", "—", "?!", "//", "_"]) if kind < 0.35 else r.choice(sorted(_STAND)) if kind < 0.8 else say(r.choice(_NOTHING_LINES), r)
    return r.choice([text, text, text.upper(), text.capitalize(), f"({text})", f"[{text}]", f"{text}."])


Example = tuple[tuple[str, ...], str, str, str]


def _examples(pairs: list[tuple[str, str, str]], lex: Lexicon, r: random.Random) -> list[Example]:
    """(classes, kind, code, label) of each pair as it is and of broken ones made from it, some broken in two ways."""
    out, labels = [], [p[2] for p in pairs]
    for kind, code, label in pairs:
        out.append(((), kind, code, label))
        chained = _chain(labels, r) if r.random() < 0.08 else ""
        if chained:
            out.append(((), kind, code, chained))
        if r.random() < 0.08 and code:  # code that something is told about is no copy
            out.append(((), kind, code, r.choice([f"{label}: {code}", f"{label} (`{code}`)", f"{code} – {label}", f"Use {code} to {label[:1].lower()}{label[1:]}"])))
        if r.random() < 0.4:  # wording that the table doesn't have
            plain, spare = say(r.choice(_PLAIN_LINES), r), say(r.choice(_PLAIN_LINES), r)
            out.append((("swapped",), kind, code, plain + r.choice(["", "", "." if plain[-1].isalpha() else ""])))
            cut = _truncate(plain, spare, r)
            last = re.sub(r".*\W", "", cut.lower(), flags=re.S)
            if r.random() < 0.3 and len(cut) > 2 and (not last or last in _ENGLISH_WORDS or last not in _PLAIN_WORDS):
                out.append((("truncated", "swapped"), kind, code, cut))
        for whole in (label, chained or label):
            cut = _truncate(whole, r.choice(labels), r)
            body = lex.template(tokenize(cut))
            if len(cut) > 2 and cut != label and body not in lex.templates and (*body, ".") not in lex.templates and not is_empty(cut):
                out.append((("truncated",), kind, code, cut))
        if r.random() < 0.35:
            other = r.choice(labels)
            parts = {p.lower() for p in _PARTS.findall(code) if len(p) > 2}
            if parts and not parts.intersection(tokenize(other)):
                out.append((("swapped",), kind, code, other))
        for make, share in (("refusal", 0.6), ("language", 0.7), ("copy", 0.7), ("empty", 0.15)):
            if r.random() < share and (make != "copy" or code.strip()):
                new = {"refusal": lambda: _refuse(r, _name(code)), "language": lambda: _foreign(code, r), "copy": lambda: _copied(code, r), "empty": lambda: _nothing(r)}[make]()  # noqa: B023
                out.append(((make,), kind, code, new))
                if make != "empty" and r.random() < 0.04 and len(new) > 24:  # broken off, too
                    out.append(((make, "truncated"), kind, code, new[: r.randint(16, len(new) - 3)].rstrip()))
        if r.random() < 0.02:
            out.append((("refusal", "language"), kind, code, f"{_refuse(r, _name(code))} {_foreign(code, r)}"))
    return out


def _mask_share(example: Example, lex: Lexicon) -> float:
    """How often an example is masked: a broken-off one only if it shows that without knowing the template."""
    classes, _, _, label = example
    if "truncated" in classes:
        last = re.sub(r".*\W", "", label.lower(), flags=re.S)
        return MASKED[1] if last in _ENGLISH_WORDS or last not in lex.words or label.count("(") > label.count(")") else 0.0
    return MASKED[0] if not classes or classes == ("swapped",) else MASKED[2]


Featurize = Callable[[Lexicon, list[tuple[str, str, str, int]]], list[np.ndarray]]


def _features_here(lex: Lexicon, pairs: list[tuple[str, str, str, int]]) -> list:
    features = Features(lex)
    return [features.of(*p) for p in pairs]


def fit(pairs: list[tuple[str, str, str]], seed: int = 7, whole: Lexicon | None = None, longest: int | None = None, featurize: Featurize = _features_here) -> Model:
    """The calibrated model of a sample of (node type, code, label); `whole` and `longest` are what all pairs tell, else the sample's own.

    Pairs with signs of a defect are no good examples; a first round on half of the sample serves to find more of them.
    """
    r = random.Random(seed)
    first, longest = whole or learn(pairs), longest or max((len(p[2]) for p in pairs), default=0)
    pairs = [p for p in pairs if not doubtful(*p[1:], first, longest)] or pairs
    model = None
    for last in (False, True):
        lex = whole or learn(pairs)
        made = _examples(pairs if last else pairs[: len(pairs) // 2], lex, r)
        masks = [r.randrange(1, 1 << 30) if r.random() < _mask_share(e, lex) else 0 for e in made]
        rows = list(featurize(lex, [(*e[1:], m) for e, m in zip(made, masks)]))
        y = [e[0] for e in made]
        features = Features(lex)
        for _ in range(2500 if last else 600):
            for classes, lines in ((("truncated",), _BROKEN_LINES), ((), _OTHER_LINES), ((), _AGAIN_LINES)):
                rows.append(features.of_error(say(r.choice(lines), r)))
                y.append(classes)
            rows.append(features.of_error(say(r.choice(_WRAP_LINES), r, _refuse(r))))
            y.append(("refusal",))
        goal = np.array([[k in c for k in TRAINED] for c in y], dtype=np.float32)
        held = np.array([i % 5 == 0 for i in range(len(rows))])
        weights = _train([x for x, h in zip(rows, held) if not h], goal[~held])
        model = Model(lex, weights, np.zeros(len(TRAINED), dtype=np.float32))
        if last:
            plain = held & np.array([not m for m in masks] + [True] * (len(rows) - len(masks)))  # as pairs will be judged
            model.thresholds = _calibrate(model.scores([x for x, h in zip(rows, plain) if h]), goal[plain])
        else:
            good = (model.scores(featurize(lex, [(*p, 0) for p in pairs]))[:, : len(CLASSES)] < DOUBT).all(axis=1)
            pairs = [p for p, g in zip(pairs, good) if g] or pairs
    return model


def _calibrate(scores: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """For each class the score with the best F1 on held-out examples, among which good ones weigh more, as they are more frequent."""
    weight = np.where(goal.any(axis=1), 0.3, 3.0)
    out = []
    for c in range(scores.shape[1]):
        order = np.argsort(-scores[:, c])
        hit = np.cumsum(weight[order] * goal[order, c])
        miss = np.cumsum(weight[order] * (goal[order, c] == 0))
        f1 = 2 * hit / np.maximum(hit + miss + (weight * goal[:, c]).sum(), 1e-9)
        at = int(np.argmax(f1))
        ends = scores[order[at : at + 2], c]  # half way to the next example below
        out.append(float(ends.mean()) if len(order) and goal[:, c].any() else 1e9)
    return np.array(out, dtype=np.float32)


def verdicts(model: Model, features: Features, rows: list[tuple[str, str, str]], classes: tuple[str, ...] = CLASSES) -> list[str | None]:
    """The defect of each (node type, code, label), of the given classes, with the highest score above its threshold, or None."""
    of = [TRAINED.index(c) for c in classes]
    margin = (model.scores([features.of(*r) for r in rows]) - model.thresholds)[:, of]
    best = margin.argmax(axis=1)
    return [classes[c] if m[c] >= 0 else None for c, m in zip(best, margin)]


def _sample(pairs: DataFrame, size: int, total: int) -> list[tuple[str, str, str]]:
    """About `size` of `total` pairs, at most twice as many, chosen by a hash of their key."""
    share = min(1.0, size / max(1, total))
    chosen = pairs.where(F.pmod(F.xxhash64("function_key", "node_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    picked = chosen.where("trim(label) != ''").select("function_key", "node_id", "node_type", F.coalesce("raw_code", F.lit("")).alias("raw_code"), "label").limit(2 * size).toPandas()
    picked = picked.sort_values(["function_key", "node_id", "label"]).drop_duplicates(["function_key", "node_id"])
    return list(zip(picked["node_type"].fillna(""), picked["raw_code"], picked["label"]))


def _spread(spark: SparkSession) -> Featurize:
    """Features of the (bounded) examples, made in tasks instead of on the driver."""

    def featurize(lex: Lexicon, pairs: list[tuple[str, str, str, int]]) -> list[np.ndarray]:
        shared = spark.sparkContext.broadcast(lex)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = Features(shared.value)
            for b in batches:
                at, kind, code, label, mask = (c.to_pylist() for c in b.columns)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([features.of(*x) for x in zip(kind, code, label, mask)], pa.list_(pa.int32()))], names=["at", "ids"])

        if not pairs:
            return []
        rows = pd.DataFrame(pairs, columns=["kind", "code", "label", "mask"])
        rows.insert(0, "at", range(len(rows)))
        made = spark.createDataFrame(rows, "at long, kind string, code string, label string, mask long").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "at long, ids array<int>").toArrow()
        out: list = [None] * len(pairs)
        for at, ids in zip(made["at"].to_pylist(), made["ids"]):
            out[at] = ids.values.to_numpy()
        return out

    return featurize


def _pairs(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type is null or node_type not in ('START', 'END')")


def fit_model(nodes: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of a table, to judge it and others by: the lexicon of all pairs, weights of a bounded sample. None without any pair."""
    pairs = _pairs(nodes)
    total, longest = pairs.agg(F.count("*"), F.max(F.length("label"))).first()
    examples = _sample(pairs, sample, total)
    return fit(examples, whole=learn_all(pairs, examples, longest), longest=longest, featurize=_spread(nodes.sparkSession)) if examples else None


def defects(nodes: DataFrame, flowcharts: DataFrame, sample: int = SAMPLE, model: Model | None = None, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """`function_key`, `node_id`, `defect` of each defective pair; by a given model, or one trained on the table itself."""
    pairs = _pairs(nodes)
    model = model or fit_model(nodes, sample)
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(model)  # DIMENSIONS weights a class and a lexicon of bounded size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        features = Features(own.lex) if own else None
        for b in batches:
            kinds, codes, labels = (b.column(i).to_pylist() for i in (2, 3, 4))
            found = verdicts(own, features, [(k or "", c or "", x) for k, c, x in zip(kinds, codes, labels)], classes) if own and len(labels) else [None] * len(labels)
            column = pa.array(found, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), column], names=["function_key", "node_id", "defect"]).filter(column.is_valid())

    def judge_errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        features = Features(own.lex) if own else None
        for b in batches:
            texts = b.column(1).to_pylist()
            margin = own.scores([features.of_error(t) for t in texts]) - own.thresholds if own and texts else np.full((len(texts), len(TRAINED)), -1.0)
            found = [max(((m[c], CLASSES[c]) for c in (1, 2) if m[c] >= 0), default=(0, None))[1] for m in margin]
            column = pa.array(found, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), column], names=["e_key", "reply"]).filter(column.is_valid())

    blank = r"label is null or not label rlike r'(?U)[^\s]'"
    spoken = widen(pairs.where(f"not ({blank})").select("function_key", "node_id", "node_type", "raw_code", "label")).mapInArrow(judge, "function_key string, node_id string, defect string")
    errors = flowcharts.where(r"error rlike r'(?U)[^\s]'").select("function_key", "error").distinct().mapInArrow(judge_errors, "e_key string, reply string").groupBy("e_key").agg(F.max("reply").alias("reply"))
    silent = pairs.where(blank).select("function_key", "node_id").distinct().join(errors, F.col("function_key") == F.col("e_key"), "left").select("function_key", "node_id", F.coalesce("reply", F.lit("empty")).alias("defect"))
    return spoken.unionByName(silent).groupBy("function_key", "node_id").agg(F.min("defect").alias("defect"))
