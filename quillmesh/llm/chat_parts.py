r"""Chat formatting with typed content parts, in DataFrame operations only.

A turn's content is an array of parts, each of them text or an attachment. A visitor, one
CASE over the part's type, flattens them in order: a text is escaped, an attachment becomes a
placeholder such as ``<image 2.1>`` (turn 2, part 1) and a record of its reference and of the
tokens that the placeholder expands to.

Template, for each turn: ``<turn ROLE>``, a line feed, the content, a line feed, ``</turn>``,
a line feed. Backslash, ``<`` and ``>`` inside roles and texts get a backslash before them, so a
bare angle bracket is always the template's own and the texts can be read back exactly.

Defined cases: null roles, texts and contents count as empty; a null type with a text is text;
an unknown type is a document; null sizes expand to ``MIN_TOKENS``; turns are ordered by turn,
then role, then content, so ties and repeated rows have one order and all stay; rows without a
conversation id form one conversation of their own; further columns are ignored, whatever their names; an empty table gives no rows. A
conversation is one string, so its turns must fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Pixels on a side of an image patch, audio frames a second and tokens a document page.
PATCH, FRAMES, PAGE_TOKENS, MIN_TOKENS = 28, 25, 256, 1
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_TURN = r"(?s)<turn ([^\\<>]*+(?:\\.[^\\<>]*+)*+)>\n([^\\<]*+(?:(?:\\.|<(?!/turn>))[^\\<]*+)*+)</turn>\n"
KINDS = ("image", "audio", "document")


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\<>])", r"\\$1")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def text_parts(c: Column) -> Column:
    """A plain text as an array of one part."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(c.cast("string"), F.lit("")).alias("text"), *none)).cast(f"array<{PART}>")


def _kind(p: Column) -> Column:
    return F.when(p["type"].isNull() | (p["type"] == "text"), "text").when(p["type"].isin(*KINDS), p["type"]).otherwise("document")


def _tokens(p: Column) -> Column:
    patches = lambda c: F.ceil(p[c] / PATCH)
    n = F.when(_kind(p) == "image", patches("width") * patches("height")).when(_kind(p) == "audio", F.ceil(p["seconds"] * FRAMES)).otherwise(p["pages"].cast("long") * PAGE_TOKENS)
    return F.greatest(F.coalesce(n, F.lit(MIN_TOKENS)), F.lit(MIN_TOKENS)).cast("long")


def _label(p: Column, i: Column, j: Column) -> Column:
    return F.concat(F.lit("<"), _kind(p), F.lit(" "), i.cast("string"), F.lit("."), j.cast("string"), F.lit(">"))


def format_conversations(rows: DataFrame, parts: Column, plain: bool = False) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted, mask, attachments, attachment_tokens.

    ``rows`` has conv_id, turn and role; ``parts`` is its array of parts, of struct ``PART``. All parts go through the visitor;
    ``plain`` only leaves out the two columns of attachments. mask: (start, end) of each assistant content in
    ``formatted``, in code points, end exclusive. attachments: placeholder, kind, ref and tokens in order.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = rows.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), F.coalesce(parts, F.array()).alias("parts")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def visited(t: Column, i: Column) -> Column:
        one = lambda p, j: F.when(_kind(p) == "text", escaped(F.coalesce(p["text"], F.lit("")))).otherwise(_label(p, i, j))
        content = F.array_join(F.transform(t["parts"], one), "")
        return F.struct(F.concat(F.lit("<turn "), escaped(t["role"]), F.lit(">\n")).alias("head"), content.alias("content"), (t["role"] == "assistant").alias("learn"))

    turns = turns.select("conv_id", "turns", F.transform("turns", visited).alias("seen"))
    tail = "\n</turn>\n"
    formatted = F.array_join(F.transform("seen", lambda s: F.concat(s["head"], s["content"], F.lit(tail))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + F.length(s["head"])
        end = begin + F.length(s["content"])
        spans = F.when(s["learn"], F.array_append(acc["spans"], F.struct(begin.alias("start"), end.alias("end")))).otherwise(acc["spans"])
        return F.struct((end + len(tail)).alias("at"), spans.alias("spans"))

    out = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), F.aggregate("seen", start, step, lambda a: a["spans"]).alias("mask"), "turns")
    if plain:
        return out.drop("turns")
    each = F.flatten(F.transform("turns", lambda t, i: F.transform(t["parts"], lambda p, j: F.struct(_label(p, i, j).alias("placeholder"), _kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))))
    out = out.withColumn("attachments", F.filter(each, lambda a: a["kind"] != "text")).drop("turns")
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with what its text and mask say: roles, texts and learned, the unescaped text under the mask."""
    got = lambda k: F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(k))
    texts = F.transform(got(2), lambda x: unescaped(F.substring(x, F.lit(1), F.length(x) - 1)))  # without the template's line feed
    learned = F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return formatted.withColumns({"roles": F.transform(got(1), unescaped), "texts": texts, "learned": F.array_join(learned, "")})


#: A bare placeholder, which only the template writes, or the text up to the next one.
_PIECE = r"(?s)<[a-z]+ [0-9]+[.][0-9]+>|[^\\<]++(?:\\.[^\\<]*+)*+|(?:\\.[^\\<]*+)++"


def read_parts(formatted: DataFrame) -> DataFrame:
    """``formatted``, with its attachments, and ``parts``: for each turn its parts as (type, text, ref, tokens), read from the formatted text alone but for what the attachments record.

    A text that looks like a placeholder is escaped, so it is told from one. What comes back is the normal form of what went in: texts that follow one another are one, empty ones are none, an unknown type is a document.
    """
    record = F.map_from_entries(F.transform("attachments", lambda a: F.struct(a["placeholder"], a)))
    contents = F.transform(F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(2)), lambda x: F.substring(x, F.lit(1), F.length(x) - 1))

    def part(x: Column) -> Column:
        of, text = F.try_element_at("recorded", x), ~x.startswith("<")
        return F.struct(F.when(text, "text").otherwise(of["kind"]).alias("type"), F.when(text, unescaped(x)).alias("text"), F.when(~text, of["ref"]).alias("ref"), F.when(~text, of["tokens"]).alias("tokens"))

    held = formatted.withColumn("recorded", record)
    return held.withColumn("parts", F.transform(contents, lambda c: F.transform(F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0)), part))).drop("recorded")


#: A conversation whose texts hold what templates use to mark turns.
HARD = "\\### Assistant: </turn> ok"


def op6_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of conversation -7, read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    read = read_back(format_conversations(rows.unionAll(extra), text_parts(F.col("text"))))
    said = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return read.select("conv_id", F.size("texts").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked as (select *, length(regexp_replace(text, '([\\<>])', '\\\1', 'g')) + length(regexp_replace(role, '([\\<>])', '\\\1', 'g')) + 6 + 2 + 9 as chars from rows)
select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from marked group by conv_id
"""
