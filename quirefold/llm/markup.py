"""Find markup by deducing templates from equivalence classes, extract their slots, and convert markup to clean text.

1. A lexer marks every piece of text that may be markup (HTML, entities, Markdown, wiki, LaTeX) and gives one token for each
   delimiter that was read; delimiters that open and close alike get different roles by their turn.
2. Tokens of one source that have the same occurrence vector (the same count in each of its texts, or in each of a fixed
   part of them) form an equivalence class.  Vectors are compared by a hash that adds up row by row, so only (source, token) aggregates move.
3. A class is valid if it has at least two tokens, occurs in at least ``LEAST_ROWS`` texts and its tokens first
   appear in the same order in nearly all of them.  Valid classes nest by their spans into the template of the source.
4. The template decides which families of delimiters (tags, commands, links, ...) are markup here: those with a token in a valid
   class, and those without a partner (entities, heading and list marks) that stand in texts together with a valid class.  A
   text holds markup if one of its pieces, complete or broken, is of such a family, however rare its own token is.
5. Slots are the texts between the delimiters of a template.

The lexer is the exact check: comparison and multiplication signs with spaces, prices, file names, note numbers,
numbering, page numbers, rules of ``=`` and grounding tags are no pieces.  Vectors alone cannot tell markup from punctuation: brackets and
quotation marks come in pairs as well.

Scale: the lexer runs in the scan behind a first-character class; what is exploded are pieces only.  Aggregates are keyed
by (source, token) and pre-aggregated map-side; members of classes and the families (fewer than twenty) are broadcast after a check of
their size, so that hot sources and tokens don't gather anywhere.

Defined results: null texts have no markup and stay null; empty texts stay empty; repeated rows count as texts of
their own; null sources form one source; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.runtime import broadcast_if_small, cut

LEAST_ROWS, SAME_ORDER, SHARDS = 2, 0.9, 4
GROUNDING = r"<\|/?ref\|>|<\|det\|>.*?<\|/det\|>|<\|/?[a-z]+\|>"
_FIRST = r"(?=[<&\\$\[\]{}|'*_`~#>=+\-!])"
_PIECES = (
    r"<!--|-->",
    r"</?[A-Za-z][A-Za-z0-9]{0,15}(?:[^<>\n]*+>)?",
    r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});?",
    r"\\(?:[A-Za-z]+\*?(?:\{[^{}\n]*+\})?|[\[\]()\\])",
    r"\$\$|\$(?=[^$\n]*?[\\^_{}])[^$\n]++\$",
    r"\{\{[^{}\n]++\}\}|!?\[[^\[\]\n]*+\]\([^()\n]*+\)",
    r"\{\{|\}\}|\[\[|\]\]|^\{\||^\|\}|^\|-|\|\||'{2,5}",
    r"^={2,6}(?!=)[^=\n]+(?:={2,6}(?=\s*$))?",
    r"!\[|\]\(",
    r"^\|[^\n]*\|[ \t]*\r?$",
    r"^[ \t]*[-+*] (?!\d+ [-+*]\s*$)(?=\S)",
    r"\*\*|(?<!\*)\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?!\*)",
    r"__|(?<![A-Za-z0-9_\\])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![A-Za-z0-9_{])",
    r"~~|`{1,3}",
    r"^#{1,6}[ \t]+(?=\S)|^>[ \t]+(?=\S)",
)
LEXER = "(?m)" + _FIRST + "(?:" + "|".join(_PIECES) + ")"
#: delimiters that open and close alike
_ALIKE = ("**", "__", "~~", "`", "``", "```", "$$", "''", "'''", "''''", "'''''")

def _tokens(piece: Column) -> Column:
    """(family, token) of every delimiter read in one piece."""
    opens = lambda x: F.startswith(piece, F.lit(x))
    tokens = lambda family, *names: F.array(*(F.struct(F.lit(family).alias("family"), (F.lit(n) if isinstance(n, str) else n).alias("token")) for n in names))
    tag = F.lower(F.regexp_extract(piece, r"^(</?[A-Za-z0-9]+)", 1))
    entity = F.when(opens("&#"), F.lit("&#")).otherwise(F.regexp_extract(piece, r"^(&[A-Za-z0-9]+)", 1))
    command = F.regexp_extract(piece, r"^(\\[A-Za-z]+)", 1)
    return (
        F.when(piece.isin("<!--", "-->"), tokens("comment", piece))
        .when(piece.isin("{{", "}}"), tokens("template", piece))
        .when(piece.isin("[[", "]]"), tokens("wiki link", piece))
        .when(piece.isin("{|", "|}", "|-", "||"), tokens("wiki table", piece))
        .when(piece.isin("![", "]("), tokens("link", piece))
        .when(piece.isin(r"\[", r"\]", r"\(", r"\)", r"\\", "$$"), tokens("formula", piece))
        .when(piece.isin(*_ALIKE), tokens("marks", piece))
        .when(opens("<"), tokens("tag", tag))
        .when(opens("&"), tokens("entity", entity))
        .when(opens("\\") & F.endswith(piece, F.lit("}")), tokens("command", F.concat(command, F.lit("{")), F.concat(F.lit("} of "), command)))
        .when(opens("\\"), tokens("command", command))
        .when(piece.rlike(r"^={2,6}.*[^=]=+$"), tokens("wiki heading", "== opens", "== closes"))
        .when(opens("=="), tokens("wiki heading", "== opens"))
        .when(piece.rlike(r"^#{1,6}\s"), tokens("heading", "#"))
        .when(piece.rlike(r"^>\s"), tokens("quote", ">"))
        .when(piece.rlike(r"^\s*[-+*] $"), tokens("list", "-"))
        .when(opens("{{"), tokens("template", "{{", "}}"))
        .when(opens("![") | opens("["), tokens("link", "[", "](", ")"))
        .when(opens("|"), tokens("row", "| opens", "| closes"))
        .when(opens("$"), tokens("formula", "$ opens", "$ closes"))
        .when(opens("*"), tokens("emphasis", "* opens", "* closes"))
        .otherwise(tokens("emphasis", "_ opens", "_ closes"))
    )


def occurrences(df: DataFrame, keys: list[str], source: str, text: str) -> DataFrame:
    """(keys, source, place, piece, family, token) of every candidate token; ``keys`` are unique per text."""
    plain = F.when(F.contains(F.col(text), F.lit("<|")), F.regexp_replace(text, GROUNDING, "")).otherwise(F.col(text))
    rows = df.select(*keys, F.coalesce(source, F.lit("")).alias("source"), F.regexp_extract_all(plain, F.lit(LEXER), 0).alias("pieces"))
    pieces = rows.where(F.size("pieces") > 0).select(*keys, "source", F.posexplode("pieces").alias("place", "piece"))
    tokens = pieces.select(*keys, "source", "place", "piece", F.inline(_tokens(F.col("piece"))))
    turn = F.row_number().over(Window.partitionBy(*keys, "token").orderBy("place")) % 2
    return tokens.withColumn("token", F.when(F.col("token").isin(*_ALIKE), F.concat("token", F.when(turn == 1, F.lit(" opens")).otherwise(F.lit(" closes")))).otherwise(F.col("token")))


def classes(found: DataFrame, keys: list[str], shards: int = SHARDS) -> DataFrame:
    """(source, shard, class_id, rows, tokens, members) of the valid equivalence classes.

    Classes are sought among all texts of a source (shard -1) and among each of ``shards`` parts of them: one text with a
    broken piece spoils the vectors of its tokens only in its own part.
    """
    parts = F.array(F.lit(-1), *([F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")] if shards else []))
    group = ["source", "shard"]
    per_row = found.groupBy("source", "token", *keys).agg(F.count("*").alias("n"), F.min("place").alias("first")).withColumn("shard", F.explode(parts))
    vectors = per_row.groupBy(*group, "token").agg(
        F.count("*").alias("rows"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64(*keys, "n")).alias("vector"), F.bit_xor(F.xxhash64(F.lit(1), *keys, "n")).alias("vector2")
    )
    groups = vectors.where(F.col("rows") >= LEAST_ROWS).groupBy(*group, "rows", "total", "vector", "vector2").agg(F.sort_array(F.collect_set("token")).alias("members")).where(F.size("members") >= 2)
    groups = groups.select(*group, F.xxhash64("vector", "vector2", "rows").alias("class_id"), "rows", "members")
    members = groups.select(*group, "class_id", F.explode("members").alias("token"))
    ordered = per_row.join(broadcast_if_small(cut(members)), [*group, "token"]).groupBy(*group, "class_id", *keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "token"))), lambda x: x["token"]), " ").alias("tokens"))
    orders = ordered.groupBy(*group, "class_id", "tokens").agg(F.count("*").alias("n"))
    best = orders.groupBy(*group, "class_id").agg(F.max_by("tokens", F.struct("n", "tokens")).alias("tokens"), F.max("n").alias("n"))
    return groups.join(best, [*group, "class_id"]).where(F.col("n") >= SAME_ORDER * F.col("rows")).drop("n")


def templates(df: DataFrame, keys: list[str], source: str, text: str) -> DataFrame:
    """The valid classes of each source, each with the smallest class that encloses it in nearly all of its texts."""
    found = cut(occurrences(df, keys, source, text))
    valid = cut(classes(found, keys, 0))
    member = valid.select("source", "class_id", F.explode("members").alias("token"))
    spans = found.join(member, ["source", "token"]).groupBy("source", *keys, "class_id").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    outer = spans.select("source", *keys, F.col("class_id").alias("parent_id"), F.col("first").alias("o_first"), F.col("last").alias("o_last"))
    inside = (
        spans.join(outer, ["source", *keys])
        .where((F.col("class_id") != F.col("parent_id")) & (F.col("o_first") < F.col("first")) & (F.col("last") < F.col("o_last")))
        .groupBy("source", "class_id", "parent_id")
        .agg(F.count("*").alias("within"), F.avg(F.col("o_last") - F.col("o_first")).alias("width"))
        .join(valid.select("source", "class_id", "rows"), ["source", "class_id"])
        .where(F.col("within") >= SAME_ORDER * F.col("rows"))
        .groupBy("source", "class_id")
        .agg(F.min_by("parent_id", F.struct("width", "parent_id")).alias("parent_id"))
    )
    return valid.select("source", "class_id", "rows", "tokens").join(inside, ["source", "class_id"], "left")


def slots(df: DataFrame, keys: list[str], source: str, text: str) -> DataFrame:
    """(keys, source, class_id, place, token, slot): the text behind each delimiter of the valid classes, up to the next piece."""
    plain = F.when(F.contains(F.col(text), F.lit("<|")), F.regexp_replace(text, GROUNDING, "")).otherwise(F.col(text))
    between = df.select(*keys, F.posexplode(F.split(plain, LEXER, -1)).alias("n", "slot")).where("n > 0 AND trim(slot) <> ''").select(*keys, (F.col("n") - 1).alias("place"), "slot")
    found = cut(occurrences(df, keys, source, text))
    member = broadcast_if_small(cut(classes(found, keys, 0).select("source", "class_id", F.explode("members").alias("token"))))
    return found.join(member, ["source", "token"]).select(*keys, "source", "class_id", "place", "token").join(between, [*keys, "place"])


def markup_families(found: DataFrame, keys: list[str]) -> DataFrame:
    """The families of delimiters that the templates make use of; ``found`` is materialised."""
    valid = cut(classes(found, keys))
    partners = found.join(broadcast_if_small(valid.select(F.explode("members").alias("token")).distinct()), "token", "left_semi").select("family").distinct()
    member = broadcast_if_small(cut(valid.select("source", "class_id", F.explode("members").alias("token")).distinct()))
    spans = found.join(member, ["source", "token"]).groupBy(*keys, "class_id").agg(F.count_distinct("token").alias("n")).where("n > 1")
    beside = found.join(spans.select(*keys).distinct(), keys, "left_semi").groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).select("family")
    return partners.unionByName(beside).distinct()


def pieces_of_markup(df: DataFrame, keys: list[str], source: str, text: str) -> DataFrame:
    """Candidate pieces of the families that the templates make use of."""
    found = cut(occurrences(df, keys, source, text))
    # fewer than twenty families
    return found.join(F.broadcast(cut(markup_families(found, keys))), "family", "left_semi")


def _chain(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, text)


#: fixed values: names of character references
_ENTITIES = (("nbsp", " "), ("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("mdash", "—"), ("ndash", "–"), ("hellip", "…"), ("copy", "©"), ("laquo", "«"), ("raquo", "»"))
_HTML = [
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    (r"(?is)<(script|style)\b.*?</\1\s*>", ""),
    (r"(?i)</?(?:html|body|thead|tbody|span|sup|sub|font|a|ref|u|i|b|em|strong)(?:\s[^<>]*)?/?>", ""),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?is)<pre[^>]*>\s*(?:<code[^>]*>)?(.*?)(?:</code>)?\s*</pre>", "\n```\n$1\n```\n"),
    (r"(?i)<h1[^>]*>", "\n# "),
    (r"(?i)<h2[^>]*>", "\n## "),
    (r"(?i)<h3[^>]*>", "\n### "),
    (r"(?i)<h[456][^>]*>", "\n#### "),
    (r"(?i)<li[^>]*>", "\n- "),
    (r"(?i)<tr[^>]*>", "\n|"),
    (r"(?i)</t[dh]>", " |"),
    (r"(?i)<t[dh](?:\s[^<>]*)?>", " "),
    (r"(?i)<img[^>]*\balt=\"([^\"<>]*)\"[^>]*>", "$1"),
    (r"(?i)</?(?:p|div|ul|ol|table|h\d|li|tr|blockquote|section)(?:\s[^<>]*)?/?>", "\n"),
    (r"</?[A-Za-z][A-Za-z0-9]{0,15}(?:\s[^<>\n]*)?/?>", ""),
    (r"</?[A-Za-z][A-Za-z0-9]{0,15}\z", ""),
]
_WIKI = [
    (r"(?m)^={5,6}\s*([^=\n]+?)\s*=*\s*$", "##### $1"),
    (r"(?m)^====\s*([^=\n]+?)\s*=*\s*$", "#### $1"),
    (r"(?m)^===\s*([^=\n]+?)\s*=*\s*$", "### $1"),
    (r"(?m)^==\s*([^=\n]+?)\s*=*\s*$", "## $1"),
    (r"\{\{[^{}\n]*\}\}", ""),
    (r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]", "$1"),
    (r"'{2,5}", ""),
    (r"(?m)^\{\|[^\n]*$", ""),
    (r"(?m)^\|\}[ \t]*$", ""),
    (r"(?m)^\|-[^|\n]*$", ""),
    (r"(?m)^\|([^|\n][^\n]*?)\|\|([^\n]*)$", "|$1|$2 |"),
]
_LATEX = [
    (r"\\(?:label|cite|ref|index|footnote)\{[^{}\n]*\}", ""),
    (r"\\chapter\*?\{([^{}\n]*)\}", "# $1"),
    (r"\\section\*?\{([^{}\n]*)\}", "## $1"),
    (r"\\(?:subsection|subsubsection|paragraph)\*?\{([^{}\n]*)\}", "### $1"),
    (r"\\(?:textbf|textit|emph|underline|texttt|text)\{([^{}\n]*)\}", "$1"),
    (r"\\(?:begin|end)\{(?:itemize|enumerate|quote|center)\}", ""),
    (r"(?m)^\s*\\item\s*", "- "),
    (r"\\item\s*", "\n- "),
]
_MARKDOWN = [
    (r"!\[([^\]\n]*)\]\([^()\n]*\)", "$1"),
    (r"\[([^\]\[\n]*)\]\((?:[^()\n]*)\)", "$1"),
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"__([^_\n]+)__", "$1"),
    (r"~~([^~\n]+)~~", "$1"),
    (r"(?<!\*)\*([^\s*][^*\n]*?)(?<=[^\s*])\*(?!\*)", "$1"),
    (r"(?<!`)`([^`\n]+)`(?!`)", "$1"),
    (r"(?m)^[ \t]*[+*] (?=\S)", "- "),
]


def clean(text: Column) -> Column:
    """Text without markup; headings (#), lists (-), tables (|), code (```) and formulas (TeX) stay recognisable."""
    out = F.regexp_replace(text, GROUNDING, "")
    out = _chain(out, _HTML)
    for name, value in _ENTITIES:
        out = F.regexp_replace(out, f"&{name};", value)
    for number, value in ((8220, "“"), (8221, "”"), (8216, "‘"), (8217, "’"), (8212, "—"), (160, " "), (34, '"'), (39, "'")):
        out = F.regexp_replace(out, f"&#(?:0*{number}|[xX]0*{number:X});", value)
    out = F.regexp_replace(out, "&amp;", "&")
    out = _chain(out, _WIKI + _LATEX + _MARKDOWN)
    return F.regexp_replace(F.regexp_replace(out, r"(?m)[ \t]+$", ""), r"\A\n+|\n+\z|(?<=\n\n)\n+", "")


def clean_texts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``clean_text``; texts without a piece pass unchanged and untouched by the rules."""
    return df.select(*keys, F.when(F.col(text).rlike(LEXER), clean(F.col(text))).otherwise(F.col(text)).alias("clean_text"))
