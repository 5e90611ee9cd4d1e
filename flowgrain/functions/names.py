"""Names, signatures and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Last words of a type that are no parameter names.
TYPE_WORDS = ("int", "char", "long", "short", "double", "float", "bool", "unsigned", "signed", "const", "auto", "void")


def plain_name(name: Column) -> Column:
    """A qualified name without white space, leading `::` and parameter list, with `::` for dots."""
    bare = F.regexp_replace(F.regexp_replace(name, r"(?U)\s+", ""), r"(?<!operator)\(.*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?<=\w)\.(?=[\w~])", "::"), r"^(::|\.)+", "")


def parameter_types(signature: Column) -> Column:
    """The parameter types of a signature, joined by commas: `f(Buffer & b, int)` gives `Buffer&,int`."""
    inner = F.regexp_extract(signature, r"(?s)\((.*)\)", 1)
    tight = F.regexp_replace(F.regexp_replace(inner, r"(?U)\s*(::|[&*<>,])\s*", "$1"), r"=[^,]*", "")
    words = "|".join(TYPE_WORDS)
    one = lambda p: F.trim(F.regexp_replace(F.trim(p), rf"^(.*[\s&*>])(?!(?:{words})$)[A-Za-z_]\w*$", "$1"))
    return F.array_join(F.transform(F.split(tight, r",(?![^<>]*>)"), one), ",")
