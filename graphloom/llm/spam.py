"""Problem 8: keyword-stuffed and link-list pages, from the shapes of their lines.

A line is reduced to a shape: whether it is code, how many words it has, and which parts of them are capitalised, stand at separators,
are links, or belong to sentences.  A word belongs to a sentence if function words stand near it in its line; keyword
and product lists have almost none.  Lines are then only counted by shape: a page is flagged when more than half of its words stand in lines of
non-sentence shapes and few shapes hold most of those.  Flagged pages are grouped by their main shape over the whole collection.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.store import keep

#: Function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "a an the and or but if of to in on at by for from with as is are was were be been it its this that these those i you he she we they my your our their me them not no do does did has have had can could would should will may more than then so because when which what who how there any all each every only also into after before once up out over".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder aber wenn von zu zum zur im in an am auf bei für mit als ist sind war waren wird werden es ich du er sie wir ihr mein meine dein nicht kein keine hat haben hatte kann muss soll wie was wer warum dass weil so auch nur noch nach vor aus über dann denn sich mich dir mir danach davor".split(),
    "fr": "le la les un une des du de et ou mais si à au aux en dans sur par pour avec comme est sont était être il elle on nous vous ils je tu mon ma mes ton ta ce cet cette ces ne n que qui quoi dont où plus puis car a ai ont avait peut faut cela se y même tous trop fois après avant depuis".split(),
    "es": "el la los las un una unos unas y o pero si de del a al en por para con como es son era ser está estaba lo le les se me te mi mis tu su sus yo no que qué quien cuando donde ya más muy este esta esto ese esa hay ha han he puede porque sin sobre entre desde hasta todo cada después luego al nos".split(),
}
_FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words)
#: Elided and contracted function words (fixed values).
_ELIDED = re.compile(r"^(?:[cdjlmnst]|qu)['’]\w|\w(?:n['’]t|['’](?:s|ve|re|ll|m|d))$", re.I)

_LINK = re.compile(
    r"\[(?P<text>[^\]\n]*)\]\(\s*\S+?\s*\)|(?:https?|hxxps?|ftp)\s*:\s*//[^\s<>\"')\]]+|\bwww\s*\.\s*[\w.-]+(?:\s*\.\s*\w+)*(?:\s*/\s*[\w./-]+)*"
    r"|\b[\w-]+(?:\.[\w-]+)+\s*\(dot\)\s*\S+|\b[\w-]+(?:\.[\w-]+)+/[\w./?=&%-]*"
)
_FENCE = re.compile(r"^\s*(```|~~~)")
_HTML_CODE = re.compile(r"<(pre|code)\b[^>]*>(.*?)(?:</\1>|\Z)", re.S | re.I)
_ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a>", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|br|li|ul|ol|div|tr|td|h\d|blockquote)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-z][^<>]*>", re.I)
_INLINE = re.compile(r"`[^`\n]+`")
_LOG = re.compile(r"^\s*\[?(?:\d{4}-\d\d-\d\d[ T])?\d\d:\d\d:\d\d|^\s*(?:\$|>>>|#!|//|--\s)")
_CODE_WORD = re.compile(r"[_{}=;\\$]|\w\(|->|::|^--")
_SEPARATOR = re.compile(r"^[\W_]+$")
_EDGE = re.compile(r"^[^\w@+#]+|[^\w@+]+$")
_SPLIT = re.compile(r"[\s|•·]+|[,;](?=\s|$)")
#: Reach in words within which function words make a sentence part, and how many are needed.
NEAR, NEEDED = 6, 2
#: Words and links of a text of one line that is a remark and no page: a few words, or a short line with a sentence's end.
REMARK, SHORT, ONE_LINK = 3, 7, 1
#: Quarters of a line's words outside sentences from which its shape is no sentence shape.
LOOSE = 3
_LINK_WORD = "\x01"

SHAPES = "doc_id bigint, shape string, lines bigint, words bigint, loose bigint"


def _part(value: int, of: int) -> int:
    """A share in quarters, rounded up."""
    return -(-4 * value // of) if of else 0


def near_distinct(function: list[str]) -> list[bool]:
    """For each word whether enough different function words ("" is none) stand within reach of it."""
    n, held, out = len(function), {}, []
    for at in range(-NEAR, n):
        if at + NEAR < n and (w := function[at + NEAR]):
            held[w] = held.get(w, 0) + 1
        if at > NEAR and (w := function[at - NEAR - 1]):
            held[w] -= 1
            if not held[w]:
                del held[w]
        if at >= 0:
            out.append(len(held) >= NEEDED)
    return out


def line_shape(line: str, code: bool) -> tuple[str, int, int, bool] | None:
    """Shape, words, words outside sentences, and whether one function word alone makes it a short sentence; None without words."""
    weak, links = False, line.count(_LINK_WORD)
    pieces = [p for p in _SPLIT.split(line) if p]
    if code or _LOG.match(line):
        words = sum(1 for p in pieces if not _SEPARATOR.match(p))
        return ("code", words, 0, False) if words else None
    bare = [_LINK_WORD if _LINK_WORD in p else _EDGE.sub("", p) for p in pieces]
    kept = [(p, b) for p, b in zip(pieces, bare) if b and not (_SEPARATOR.match(p) and b != _LINK_WORD)]
    n = len(kept)
    if not n:
        return None
    codelike = sum(1 for p, b in kept if b != _LINK_WORD and _CODE_WORD.search(p))
    if codelike * 10 >= 4 * n and not links and n > 1:
        return "code", n, 0, False
    function = [low if (low := b.lower()) in _FUNCTION else "'" if _ELIDED.search(b) else "" for _, b in kept]
    loose = n - sum(near_distinct(function))
    if loose and n <= 2 * NEAR and any(function) and not links and line.rstrip(" \"')»").endswith((".", "?", "!", ":")):
        weak, loose = True, 0
    capitals = sum(1 for _, b in kept if b[:1].isupper())
    marks = len(pieces) - n + sum(1 for p, _ in kept if p[0] == "#") + line.count("|") + line.count(",") + line.count(";")
    shape = f"words {min(6, n.bit_length())} loose {_part(loose, n)} capitals {_part(capitals, n) // 2} marks {min(4, _part(marks, n)) // 2} links {min(4, _part(links, n))}"
    return shape, n, loose, weak


def text_shapes(text: str) -> dict[str, list[int]]:
    """Lines, words and words outside sentences of every shape in the whole text."""
    text = _HTML_CODE.sub(lambda m: "\n```\n" + m.group(2) + "\n```\n" if "\n" in m.group(2) or m.group(1).lower() == "pre" else f" `{m.group(2)}` ", text)
    text = _ANCHOR.sub(lambda m: f" {m.group(1)} {_LINK_WORD} ", text)
    text = html.unescape(_TAG.sub(" ", _BREAK.sub("\n", text)))
    out: dict[str, list[int]] = {}
    weak: list[tuple[str, int]] = []
    fenced, lines = False, 0

    def move(shape: str, to: str, words: int, loose: int) -> None:
        """A line of ``words`` counts under another shape."""
        held, there = out[shape], out.setdefault(to, [0, 0, 0])
        held[0], held[1] = held[0] - 1, held[1] - words
        there[0], there[1], there[2] = there[0] + 1, there[1] + words, there[2] + loose
        if not held[0]:
            del out[shape]

    for line in text.splitlines():
        if _FENCE.match(line):
            fenced = not fenced
            continue
        indented = line[:1] == "\t" or line[:4] == "    "
        if not (fenced or indented):
            line = _LINK.sub(lambda m: f" {m.group('text') or ''} {_LINK_WORD} ", line)
            line = _INLINE.sub(" code ", line)
        got = line_shape(line, fenced or indented)
        if got:
            shape, words, loose, short = got
            lines += 1
            weak += [(shape, words)] * short
            held = out.setdefault(shape, [0, 0, 0])
            held[0] += 1
            held[1] += words
            held[2] += loose
    if len(weak) > 3 and 2 * len(weak) > lines:  # many short lines with one function word each are a list as well
        for shape, words in weak:
            move(shape, shape.replace("loose 0", "loose 4"), words, words)
    if lines == 1:
        (shape, (_, words, _)), links = next(iter(out.items())), text.count(_LINK_WORD) + len(_LINK.findall(text))
        if links <= ONE_LINK and (words <= REMARK or words <= SHORT and text.rstrip(" \n\"')»").endswith((".", "?", "!"))):
            move(shape, "remark", words, 0)
    return out


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("shape", pa.string()), ("lines", pa.int64()), ("words", pa.int64()), ("loose", pa.int64())])
    for batch in batches:
        rows = [(i, s, *v) for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) if text for s, v in text_shapes(text).items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def line_shapes(documents: DataFrame) -> DataFrame:
    """``(doc_id, shape, lines, words, loose)`` of every shape in every whole text of ``(doc_id, text)``."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_shapes, SHAPES)


def stuffed_pages(documents: DataFrame, share: float = 0.5, few: int = 4) -> DataFrame:
    """``(doc_id, words, loose_share, shapes, main_shape, link_list, pages_alike)`` of the pages that are lists and not sentences.

    A page is flagged when more than ``share`` of its words are in lines of non-sentence shapes and its ``few`` commonest of those
    hold at least half of them.  ``pages_alike`` counts the flagged pages of the same main shape.  Null, empty and wordless texts are never flagged, nor is
    a remark of one short line; of rows with one ``doc_id`` the words are added; an empty table gives none.
    """
    shapes = line_shapes(documents)
    page = Window.partitionBy("doc_id")
    order = page.orderBy(F.desc("listed"), "shape")
    part = F.coalesce(F.try_to_number(F.regexp_extract("shape", r"loose (\d)", 1), F.lit("9")).cast("int"), F.lit(0))
    shapes = shapes.groupBy("doc_id", "shape").agg(F.sum("words").alias("words")).withColumn("listed", F.when(part >= LOOSE, F.col("words")).otherwise(0))
    ranked = shapes.withColumn("r", F.row_number().over(order))
    totals = ranked.groupBy("doc_id").agg(
        F.sum("words").alias("words"), F.sum("listed").alias("listed"), F.sum(F.when(F.col("r") <= few, F.col("listed")).otherwise(0)).alias("main"),
        F.sum((F.col("listed") > 0).cast("int")).alias("shapes"), F.min_by("shape", "r").alias("main_shape"),
    )
    flagged = keep(totals.where((F.col("listed") > F.lit(share) * F.col("words")) & (F.col("main") * 2 >= F.col("listed"))))
    alike = flagged.groupBy("main_shape").agg(F.count(F.lit(1)).alias("pages_alike"))  # shapes are fewer than 2,000 whatever the collection
    return flagged.join(F.broadcast(alike), "main_shape").select(
        "doc_id", "words", F.round(F.col("listed") / F.col("words"), 6).alias("loose_share"), "shapes", "main_shape", (~F.col("main_shape").endswith("links 0")).alias("link_list"), "pages_alike"
    )
