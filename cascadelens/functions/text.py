"""Source text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that count as keywords, the form of a function, the form of a run of
# constants, and the mark of files that are passed over as a whole.
KEYWORDS = "int float double char void if else for while do switch case return break continue struct union enum typedef const static extern malloc free sizeof printf scanf".split()
FUNCTION = r"(?:^|\n)([a-zA-Z_][a-zA-Z0-9_]*\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\([^)]*\)\s*\{[^}]*\})"
# a run is tried from its beginning only, or every place in a long one would be tried to its end
CONSTANTS = r"(?<![0-9a-fA-FxX\s])(?<![0-9a-fA-FxX\s],)(?:[0-9a-fA-FxX\s]++,){10000,}+"
BLACKLISTED = "# E-mail..................: [Ciph3r_blackhat@yahoo.com]"


def preprocess(content: Column) -> Column:
    """Comments out, blanks folded, quotes emptied, braces and semicolons set apart, ends trimmed.

    The order matters: a `//` inside quotes ends the line too. (?d) keeps `.` from stopping at `\\r`.
    """
    steps = [(r"(?d)//.*", ""), (r"(?s)/\*.*?\*/", ""), (r"\s+", " "), (r'"[^"]*"', '""'), (r"'[^']*'", "''"), (r"([{};])", " $1 ")]
    for pattern, new in steps:
        content = F.regexp_replace(content, pattern, new)
    return F.trim(content)


def tokens(content: Column) -> Column:
    """Words and single operator characters."""
    # \w has the ASCII ones, which are told faster
    return F.regexp_extract_all(content, F.lit(r"[\w\p{L}\p{N}]++|[+\-*/=<>!&|]"), F.lit(0))


def feature_class(token: Column) -> Column:
    """keyword, identifier, operator, or null for tokens that stand only in bigrams."""
    return (
        F.when(F.lower(token).isin(KEYWORDS), "keyword")
        .when(token.rlike(r"^\p{L}+$"), "identifier")
        .when(~token.rlike(r"^[\p{L}\p{N}]+$"), "operator")
    )


def without_comments(content: Column) -> Column:
    """Comments out, but not those inside string and character literals; blank lines out, lines trimmed."""
    # possessive groups are matched in a loop; others recurse, and overflow the stack on long literals
    literal = r"""("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')"""
    bare = F.regexp_replace(content, rf"(?ms){literal}|//[^\n]*|/\*.*?\*/", "$1")
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    return F.array_join(lines, "\n")


def normalized(content: Column) -> Column:
    """Without blanks and braces."""
    return F.regexp_replace(content, r"[\s{}]", "")


def extracted_functions(content: Column) -> Column:
    """Functions of the form `type name(arguments) { ... }` up to the first closing brace."""
    return F.regexp_extract_all(content, F.lit(FUNCTION), F.lit(1))


def placed_functions(content: Column) -> Column:
    """array<struct<func, line_no>>: those functions with the line on which each begins.

    Matches follow one another, so each is looked for behind the end of the one before; of equal
    functions each has its own line.
    """
    whole = F.regexp_extract_all(content, F.lit(FUNCTION), F.lit(0))
    none = F.array().cast("array<struct<func:string,at:int>>")

    def add(seen: Column, match: Column) -> Column:
        at = F.call_function("locate", match, content, seen["next"])
        return F.struct((at + F.length(match)).alias("next"), F.concat(seen["found"], F.array(F.struct(match.alias("func"), at.alias("at")))).alias("found"))

    found = F.aggregate(whole, F.struct(F.lit(1).alias("next"), none.alias("found")), add, lambda s: s["found"])
    func = lambda x: F.regexp_replace(x["func"], "^\n", "")
    before = lambda x: F.substring(content, F.lit(1), x["at"] + F.length(x["func"]) - F.length(func(x)) - 1)
    return F.transform(found, lambda x: F.struct(func(x).alias("func"), (F.length(before(x)) - F.length(F.replace(before(x), F.lit("\n"), F.lit(""))) + 1).alias("line_no")))


def without_huge_arrays(content: Column) -> Column:
    """Runs of ten thousand constants or more are taken out of texts of over 20,000 characters; a text with the mark is emptied."""
    return F.when(F.contains(content, F.lit(BLACKLISTED)), "").when(F.length(content) > 20000, F.regexp_replace(content, CONSTANTS, "")).otherwise(content)


def duration(seconds: Column) -> Column:
    """`01h 02m 03s` of a number of seconds."""
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%02dh %02dm %02ds", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)
