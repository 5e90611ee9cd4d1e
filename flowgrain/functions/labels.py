"""Labels, conditions, calls and signatures of chart nodes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowgrain.functions.text import strip

#: Fixed value: the first line of a chart script.
CHART_HEADER = "flowchart TD"
# Entities of characters that have a meaning in a chart script. The semicolon comes first, since the
# entities themselves bring in semicolons.
NODE_ENTITIES = {";": "#59;", "&": "#38;", '"': "#quot;", "[": "#91;", "]": "#93;", "(": "#40;", ")": "#41;", "{": "#123;", "}": "#125;", "|": "#124;", "%": "#37;", "^": "#94;", "~": "#126;", "<": "#60;", ">": "#62;"}
EDGE_ENTITIES = {c: e for c, e in NODE_ENTITIES.items() if c not in "%^~"}
# Comparisons and connectives in words, in the order in which they are replaced.
COMPARISONS = (("==", "equals"), ("!=", "does not equal"), (">=", "is greater than or equal to"), ("<=", "is less than or equal to"), (">", "is greater than"), ("<", "is less than"))
CONNECTIVES = (("&&", "AND"), (r"\|\|", "OR"))
# Beginnings of the names of yes-or-no methods.
PREDICATES = ("is", "has", "can", "should", "will", "was", "are", "have", "did", "does", "check", "needs")
# Node types by shape.
STADIUM, DIAMOND, SUBROUTINE = ("START", "END"), ("DECISION", "LOOP_HEAD", "SWITCH_HEAD"), ("CATCH",)
NODE_TYPES = (*STADIUM, "ACTION", *DIAMOND, "CASE", "DEFAULT_CASE", "RETURN", "BREAK", "CONTINUE", "TRY_HEAD", *SUBROUTINE)
_BREAK = "\u0001"


def _entities(c: Column, table: dict[str, str]) -> Column:
    for char, entity in table.items():
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def escape_node(label: Column) -> Column:
    """A node label for a script: line ends become `<br/>`, special characters entities."""
    c = label
    for mark in ("<br/>", "<br />", "\n"):
        c = F.replace(c, F.lit(mark), F.lit(_BREAK))
    return F.replace(_entities(F.replace(c, F.lit("\r"), F.lit("")), NODE_ENTITIES), F.lit(_BREAK), F.lit("<br/>"))


def escape_edge(label: Column) -> Column:
    return _entities(label, EDGE_ENTITIES)


def edge_label(label: Column) -> Column:
    """`Yes` or `No` for their synonyms, null for blank, else the stripped label."""
    s = strip(label)
    low = F.lower(s)
    return F.when(s == "", None).when(low.isin("yes", "true", "1"), "Yes").when(low.isin("no", "false", "0"), "No").otherwise(s)


def node_line(node_id: Column, node_type: Column, label: Column, raw_code: Column) -> Column:
    """The line that defines a node, in the shape of its type."""
    text = escape_node(F.coalesce(F.when(label != "", label), F.when(raw_code != "", F.substring(raw_code, 1, 60)), node_id))
    shape = lambda a, b: F.concat(node_id, F.lit(a), text, F.lit(b))
    return F.when(node_type.isin(*STADIUM), shape("([", "])")).when(node_type.isin(*DIAMOND), shape("{", "}")).when(node_type.isin(*SUBROUTINE), shape("[[", "]]")).otherwise(shape("[", "]"))


def edge_line(source: Column, target: Column, label: Column) -> Column:
    text = edge_label(label)
    return F.when(text.isNull(), F.concat(source, F.lit(" --> "), target)).otherwise(F.concat(source, F.lit(" -->|"), escape_edge(text), F.lit("| "), target))


def predicate_phrase(method: Column, negated: Column) -> Column:
    """What a yes-or-no method tells, by the first prefix in the list that begins its name; null if none does."""

    def said(m: Column) -> Column:
        prefix = F.lower(F.regexp_extract(m, rf"(?i)^({'|'.join(PREDICATES)})(?=.)", 1))
        words = F.lower(F.trim(F.regexp_replace(F.substring(m, F.length(prefix) + 1, F.lit(1 << 30)), "([A-Z])", " $1")))
        to_be = prefix.isin("is", "are")
        begin = F.when(to_be & negated, "is not ").when(to_be, "is ").when(negated, F.concat(F.lit("does not "), prefix, F.lit(" "))).otherwise(F.concat(prefix, F.lit("s ")))
        return F.when(prefix != "", F.concat(begin, words))

    return F.transform(F.array(method), said)[0]


def predicate(expression: Column) -> Column:
    """`[!]object->isReady(...)` or `[!]isReady(...)` in words, else null."""
    with_object = r"^(?:!\s*)?([\w\->:.*]+?)\s*->\s*(\w+)\s*\("

    def said(e: Column) -> Column:
        owner = F.regexp_extract(e, with_object, 1)
        negated = e.startswith("!")
        owned = predicate_phrase(F.regexp_extract(e, with_object, 2), negated)
        alone = predicate_phrase(F.regexp_extract(e, r"^(?:!\s*)?(\w+)\s*\(", 1), negated)
        return F.coalesce(F.when(owner != "", F.concat(owner, F.lit(" "), owned)), alone)

    return F.transform(F.array(expression), said)[0]


def plain_symbols(c: Column) -> Column:
    """null for null pointers, dots for arrows, no scopes, address marks or closing semicolons."""
    c = F.regexp_replace(c, r"\b(nullptr|NULL)\b", "null")
    c = F.replace(F.replace(c, F.lit("->"), F.lit(".")), F.lit("&"), F.lit(" "))
    return strip(F.regexp_replace(F.regexp_replace(c, r"\w+::", ""), ";+$", ""))


def condition(raw: Column) -> Column:
    """A condition in words: a predicate call alone decides; else comparisons, connectives and symbols are replaced."""
    s = strip(raw)
    words = s
    for sign, said in (*COMPARISONS, *CONNECTIVES):
        words = F.regexp_replace(words, rf"\s*{sign}\s*", f" {said} ")
    return F.when(s == "", s).otherwise(F.coalesce(predicate(s), plain_symbols(words)))


def rule_label(node_type: Column, raw_code: Column) -> Column:
    """The label that a node gets by rule, from its type and code."""
    raw = F.substring(strip(raw_code), 1, 120)
    said = lambda before, after="": F.concat(F.lit(before), raw, F.lit(after))
    first_line = F.substring(F.coalesce(F.get(F.filter(F.transform(F.split(raw, r"\r\n|\r|\n"), strip), lambda x: x != ""), F.lit(0)), raw), 1, 80)
    fixed = {"DEFAULT_CASE": "Default case", "BREAK": "Exit loop", "CONTINUE": "Continue to next iteration", "TRY_HEAD": "Execute with exception handling"}
    out = (
        F.when(node_type == "DECISION", F.when(raw.endswith("?"), raw).otherwise(said("Check: ", "?")))
        .when(node_type == "LOOP_HEAD", said("Loop: ", "?"))
        .when(node_type == "SWITCH_HEAD", said("Switch on: ", "?"))
        .when(node_type == "CASE", said("Case: "))
        .when(node_type == "RETURN", F.concat(F.lit("Return "), F.regexp_replace(strip(F.regexp_replace(raw, "^return", "")), ";+$", "")))
        .when(node_type == "CATCH", said("Handle exception: "))
    )
    for kind, label in fixed.items():
        out = out.when(node_type == kind, label)
    return out.otherwise(first_line)


def simple_type(c: Column) -> Column:
    """The last part of a type up to the first mark or blank: `ns::Mode *` gives Mode."""
    return F.regexp_replace(F.element_at(F.split(c, "::"), -1), r"[*&<> ].*", "")


def simple_name(qualified: Column) -> Column:
    """Template arguments off, then the part after the last `::`."""
    return F.element_at(F.split(F.substring_index(qualified, "<", 1), "::"), -1)


def last_name(qualified: Column) -> Column:
    """The part after the last `::`, then template arguments off."""
    return F.substring_index(F.element_at(F.split(qualified, "::"), -1), "<", 1)


def call_names(code: Column) -> Column:
    """Distinct names before an opening bracket, in the order of their first place."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?U)(\w[\w:~<>]*)\s*\("), F.lit(1)))


def identifiers(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?U)\b([A-Za-z_]\w*)\b"), F.lit(1)))


def macro_names(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?U)\b([A-Z_][A-Z0-9_]{2,})\b"), F.lit(1)))


def parameters(params: Column) -> Column:
    """`type name, type name` of an array of (type, name)."""
    one = lambda p: strip(F.concat(F.coalesce(p["type"], F.lit("")), F.lit(" "), F.coalesce(p["name"], F.lit(""))))
    return F.array_join(F.transform(params, one), ", ")


def full_signature(qualified: Column, params: Column) -> Column:
    return F.concat(qualified, F.lit("("), F.coalesce(parameters(params), F.lit("")), F.lit(")"))


def with_comment(text: Column, comment: Column) -> Column:
    """text, and two blanks and the comment in brackets if there is one."""
    return F.when(F.coalesce(comment, F.lit("")) != "", F.concat(text, F.lit("  ("), comment, F.lit(")"))).otherwise(text)


def macro_summary(name: Column, value: Column, comment: Column) -> Column:
    return with_comment(F.concat(name, F.lit(" = "), value), comment)


def typedef_summary(name: Column, underlying: Column, comment: Column) -> Column:
    return with_comment(F.concat(name, F.lit(" → "), underlying), comment)


def enum_summary(comment: Column, values: Column, most: int = 8) -> Column:
    """The comment and the first values of an array of (name, value, comment), with a note on how many more there are."""
    one = lambda v: F.concat(v["name"], F.lit("="), v["value"], F.when(F.coalesce(v["comment"], F.lit("")) != "", F.concat(F.lit(" ("), v["comment"], F.lit(")"))).otherwise(""))
    shown = F.concat(F.lit("values: "), F.array_join(F.transform(F.slice(values, 1, most), one), ", "))
    more = F.when(F.size(values) > most, F.concat(F.lit("  ... and "), (F.size(values) - most).cast("string"), F.lit(" more")))
    return F.concat_ws("; ", F.when(comment != "", comment), F.when(F.size(values) > 0, shown), more)


def first_json_object(text: Column) -> Column:
    """The first `{` to the bracket that closes it, code fences taken off; null if there is none. Brackets in strings count.

    Only the brackets are walked through: the one that closes is the n-th `}`.
    """

    def found(rest: Column) -> Column:
        step = lambda s, c: F.struct(
            F.when(s["done"], s["depth"]).when(c == "{", s["depth"] + 1).otherwise(s["depth"] - 1).alias("depth"),
            F.when(s["done"] | (c == "{"), s["closed"]).otherwise(s["closed"] + 1).alias("closed"),
            (s["done"] | ((c == "}") & (s["depth"] == 1))).alias("done"),
        )
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"), F.lit(False).alias("done"))
        n = F.aggregate(F.regexp_extract_all(rest, F.lit("[{}]"), F.lit(0)), start, step, lambda s: F.when(s["done"], s["closed"]))
        return F.when(n > 0, F.concat(F.call_function("substring_index", rest, F.lit("}"), n), F.lit("}")))

    bare = F.regexp_replace(F.regexp_replace(text, r"```(?:json)?\s*", ""), "```", "")
    return F.transform(F.array(F.when(bare.contains("{"), F.concat(F.lit("{"), F.regexp_extract(bare, r"(?s)^[^{]*\{(.*)$", 1)))), found)[0]
