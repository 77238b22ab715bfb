"""Line dedup by content-defined chunks of lines.

Prose keeps a paragraph on one line, so a line here ends at a line break or
after the blank that follows a sentence's end (`.`, `!`, `?`). A rolling (cyclic polynomial)
hash runs over the hashes of neighbouring lines; a chunk ends where it is
smaller than before and after. That depends on a few lines only, so chunks of a
moved passage are the same again, and no chunk has fewer than two lines unless
its surroundings have. A paragraph of `long_words` or more words is always a
chunk border on both sides; words are counted by blanks. Chunks of two lines or
more, or of `min_words` words, count; of those that occur again, in bytes and apart from blanks at the
end, the occurrences after the first are removed. DataFrame functions only.

Chunks lose the ends of a passage, whose chunks hold neighbouring lines too.
`passages` finds every run of `passage_words` words that stands elsewhere
first, wherever it begins. A window of that many words is named by the least
hash of its stretches of STRETCH words, equal windows by the same one, and
windows of one name in a row are a run. Runs of one name and equal words, by a
64-bit digest each, go as a whole, all but those of the first document. Only the
windows of these first ones whose name occurs in runs of other words, or twice in
one document, are compared, by a 128-bit digest of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.functions.text import let
from pairlight.session import cut

LONG_WORDS, MIN_WORDS = 20, 50
#: Words of a stretch that names windows; a power of two.
STRETCH = 16
_LAST = (1 << 63) - 1


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _turned(h: Column) -> Column:
    return F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63))


def chunks(text: Column, long_words: int = LONG_WORDS) -> Column:
    """Chunks of a text in order, as arrays of lines that together are the text; null has none."""
    # literal replacements and splits at one character: regular expressions cost several times as much here
    def of_paragraph(p: Column, last: Column) -> Column:
        ended = F.replace(F.replace(F.replace(p, F.lit(". "), F.lit(". \n")), F.lit("! "), F.lit("! \n")), F.lit("? "), F.lit("? \n"))
        parts = let(F.split(ended, "\n", -1), lambda x: F.when(F.size(x) > 1, F.filter(x, lambda t: t != "")).otherwise(x))
        # a line: its text, its hash, whether it opens a paragraph, whether its paragraph is long
        return let(_blanks(p) + 1 >= long_words, lambda far: let(parts, lambda x: F.transform(x, lambda t, i: F.struct(
            F.when(last | (i < F.size(x) - 1), t).otherwise(F.concat(t, F.lit("\n"))).alias("t"), F.xxhash64(F.rtrim(t)).alias("h"), (i == 0).alias("first"), far.alias("far")))))

    lines = let(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda ps: F.flatten(F.transform(ps, lambda p, k: of_paragraph(p, k == F.size(ps) - 1))))
    lines = F.filter(lines, lambda x: x["t"] != "")

    def cut_up(u: Column) -> Column:
        n = F.size(u)
        at = lambda i: F.get(u, i)
        # hard[i]: a border behind line i
        hard = F.transform(u, lambda x, i: (i == n - 1) | (F.coalesce(at(i + 1)["first"], F.lit(True)) & (x["far"] | F.coalesce(at(i + 1)["far"], F.lit(False)))))

        def roll(b: Column) -> Column:
            rolled = F.transform(u, lambda x, i: F.when((i == 0) | F.coalesce(F.get(b, i - 1), F.lit(True)), x["h"]).otherwise(_turned(at(i - 1)["h"]).bitwiseXOR(x["h"])))
            return let(rolled, lambda r: borders(b, r))

        def borders(b: Column, r: Column) -> Column:
            inside = lambda i: (i >= 0) & ~F.coalesce(F.get(b, i), F.lit(True))
            low = lambda i: inside(i - 1) & inside(i) & inside(i + 1) & (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) < F.get(r, i + 1))
            ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(b, i) | low(i))
            return let(ends, lambda e: F.transform(e, lambda end, k: let(F.when(k == 0, F.lit(-1)).otherwise(F.get(e, k - 1)), lambda before: F.transform(F.slice(u, before + 2, end - before), lambda x: x["t"]))))

        return F.when(n == 0, F.array().cast("array<array<string>>")).otherwise(let(hard, roll))

    return let(lines, cut_up)


def _bare(chunk: Column) -> Column:
    """A chunk's bytes without blanks and line ends behind them."""
    return F.rtrim(F.array_join(chunk, ""), F.lit(" \n"))


def _counts(chunk: Column, text: Column, min_words: int) -> Column:
    return (F.size(chunk) > 1) | (_blanks(text) + 1 >= min_words)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     "), " ", -1), "")


def _spread(x: Column, width: int, now: int, op) -> tuple[Column, int]:
    """op over x[i] and x[i + by], for values that cover `now` places each and then more, `width` at most."""
    by = min(now, width - now)
    return F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - by, F.lit(0))), F.slice(x, by + 1, F.greatest(F.size(x) - by, F.lit(0))), op), now + by


def _names(hashed: Column, n: int) -> Column:
    """For each window of n words, its name; `hashed` are the words' hashes."""
    def grown(x: Column, now: int, width: int, op, then) -> Column:
        if now == width:
            return then(x)
        made, wider = _spread(x, width, now, op)
        return let(made, lambda m: grown(m, wider, width, op, then))

    least = lambda s: grown(s, 1, n - STRETCH + 1, lambda a, b: F.least(a, b), lambda m: m)
    return grown(hashed, 1, STRETCH, lambda a, b: F.xxhash64(a, b), least)


def _runs(words: Column, n: int) -> Column:
    """The windows of n words as runs of equal names: name, at (from 1), n, digest of the run's words, whether the text has the name again."""
    def cells(h: Column, names: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(names)), lambda i: (i == 1) | (F.get(names, i - 1) != F.get(names, i - 2)))

        def made(b: Column) -> Column:
            here = F.array_sort(F.transform(b, lambda i: F.get(names, i - 1)))
            again = let(here, lambda x: F.filter(x, lambda v, k: (k > 0) & (v == F.get(x, k - 1))))
            ends = lambda k: F.coalesce(F.get(b, k + 1), F.size(names) + 1)
            return let(again, lambda twice: F.transform(b, lambda i, k: let(F.slice(h, i, ends(k) - i + n - 1), lambda own: F.struct(
                F.get(names, i - 1).alias("name"), i.alias("at"), (ends(k) - i).alias("n"), F.xxhash64(own).alias("words"),
                F.array_contains(twice, F.get(names, i - 1)).alias("twice")))))

        return F.when(F.size(names) > 0, let(begins, made))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(_names(h, n), lambda names: cells(h, names)))


def passages(docs: DataFrame, n: int = MIN_WORDS) -> DataFrame:
    """(owner, version, starts): places, sorted from 1, of the windows of n words of `docs` (owner, version, text) that stand elsewhere first.

    First is the smallest owner; in one text also a window that ends before. Texts of one owner keep each other's.
    """
    if n < STRETCH:
        raise ValueError(f"windows need {STRETCH} words")
    runs = cut(docs.select("owner", "version", F.explode(_runs(_words(F.col("text")), n)).alias("c")).select("owner", "version", "c.*"))
    equal = runs.groupBy("name", "words").agg(F.min("owner").alias("first"), F.max("owner").alias("last"), F.max("n").alias("longest"), F.max("twice").alias("twice"))
    # a text can repeat itself inside one run of equal names (a run of one word)
    often = equal.groupBy("name").agg(F.count(F.lit(1)).alias("kinds"), F.max("longest").alias("longest"), F.max("twice").alias("twice")).where(f"kinds > 1 or longest > {n} or twice").select("name", F.lit(True).alias("often"))
    told = cut(equal.join(often, "name", "left").where("often or first < last").select("name", "words", "first", F.coalesce("often", F.lit(False)).alias("often")))
    met = cut(runs.join(told, ["name", "words"]).where("often or owner > first").select("owner", "version", "at", "n", (F.col("owner") > F.col("first")).alias("whole")))
    whole = met.where("whole").select("owner", "version", F.sequence("at", F.col("at") + F.col("n") - 1).alias("at"))
    asked = met.where("not whole").groupBy("owner", "version").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    texts = docs.join(asked, ["owner", "version"])
    at = F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1)))
    digests = let(_words(F.col("text")), lambda w: F.transform(at, lambda i: F.struct(i.alias("at"), F.unhex(F.md5(F.array_join(F.slice(w, i, F.lit(n)), " "))).alias("d"))))
    windows = texts.select("owner", "version", F.explode(digests).alias("w")).groupBy("w.d", "owner", "version").agg(F.sort_array(F.collect_set("w.at")).alias("at"))
    windows = cut(windows)
    first = windows.groupBy("d").agg(F.min("owner").alias("first"), F.sum(F.size("at")).alias("n")).where("n > 1").select("d", "first")
    gone = F.when(F.col("owner") > F.col("first"), F.col("at")).otherwise(F.filter("at", lambda i: i >= F.get("at", F.lit(0)) + n))
    return (windows.join(first, "d").select("owner", "version", gone.alias("at")).where(F.size("at") > 0).unionByName(whole)
            .groupBy("owner", "version").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("starts")))


def _without(text: Column, chunked: Column, gone: Column, starts: Column, n: int) -> tuple[Column, Column]:
    """The text without the words of the chunks `gone` and of the windows at `starts`, and the number of stretches those windows make."""
    begins = F.filter(starts, lambda x, k: (k == 0) | (x - F.get(starts, k - 1) > n))
    ends = F.transform(F.filter(starts, lambda x, k: (k == F.size(starts) - 1) | (F.get(starts, k + 1) - x > n)), lambda x: x + n)
    of_chunks = F.flatten(F.transform(chunked, lambda c, i: F.array_repeat(gone[i].isNotNull(), F.size(_words(F.array_join(c, ""))))))
    words = F.zip_with(F.regexp_extract_all(text, F.lit(r"\S+\s*"), F.lit(0)), of_chunks, lambda t, g: F.when(g, F.lit("")).otherwise(t))

    def between(w: Column, b: Column, e: Column) -> Column:
        rest = F.transform(F.sequence(F.lit(0), F.size(b)), lambda k: let(F.when(k == 0, F.lit(1)).otherwise(F.get(e, k - 1)), lambda a: F.slice(w, a, F.coalesce(F.get(b, k), F.size(w) + 1) - a)))
        return F.concat(F.regexp_extract(text, r"^\s*", 0), F.array_join(F.flatten(rest), ""))

    return let(words, lambda w: let(begins, lambda b: let(ends, lambda e: between(w, b, e)))), F.size(begins)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", long_words: int = LONG_WORDS, min_words: int = MIN_WORDS, passage_words: int | None = None) -> DataFrame:
    """`docs` with the columns text_kept, n_lines, n_chunks, n_removed (chunks), removed_chars.

    With `passage_words`, also text_own, the text without these chunks and
    without the passages of that many words or more that stand elsewhere first,
    and n_passages, the number of stretches of such passages.

    The first occurrence is the one in the smallest doc_id, then the earliest
    in its text; rows with one doc_id count as one document and keep each
    other's chunks, rows without doc_id come last. Null text gives text_kept
    null and zeros. Bytes are compared by a 128-bit digest beside the one of 64 bits that groups
    chunks; two chunks with one of the latter and different bytes both stay.
    Columns of `docs` with one of the new names are replaced; the others,
    repeated rows included, stay. An empty table gives an empty table.
    """
    base = docs.drop("text_kept", "n_lines", "n_chunks", "n_removed", "removed_chars", *(["text_own", "n_passages"] if passage_words else []))
    key = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST))
    # what later steps need of the chunks: their digests, not their bytes
    told = let(chunks(F.col(text), long_words), lambda c: F.struct(F.size(F.flatten(c)).alias("n_lines"), F.size(c).alias("n_chunks"), F.filter(F.transform(c, lambda x, i: let(_bare(x), lambda bare: F.when(
        _counts(x, bare, min_words), F.struct(i.alias("no"), F.xxhash64(bare).alias("d"), F.unhex(F.md5(bare)).alias("bytes"))))), lambda x: x.isNotNull()).alias("found")))
    marked = cut(docs.select(key.alias("owner"), F.xxhash64(text).alias("version"), told.alias("c")).select("owner", "version", "c.*"))
    found = marked.select("owner", "version", F.explode("found").alias("f")).select("owner", "version", "f.*")
    by_bytes = found.groupBy("d", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("first"))
    repeated = by_bytes.groupBy("d").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")).where("n > 1 and texts = 1")
    own = found.groupBy("owner", "version", "d").agg(F.sort_array(F.collect_set("no")).alias("nos"))
    drop = (own.join(repeated, "d").select("owner", "version", F.when(F.col("owner") == F.col("first"), F.slice("nos", F.lit(2), F.size("nos"))).otherwise(F.col("nos")).alias("nos"))
            .where(F.size("nos") > 0).groupBy("owner", "version").agg(F.flatten(F.collect_list("nos")).alias("nos")))
    sizes = marked.groupBy("owner", "version").agg(F.first("n_lines").alias("_n_lines"), F.first("n_chunks").alias("_n_chunks"))
    there = base.withColumns({"_owner": key, "_version": F.xxhash64(text)})
    joined = there.join(drop.select(F.col("owner").alias("_owner"), F.col("version").alias("_version"), F.col("nos").alias("_nos")), ["_owner", "_version"], "left")
    joined = joined.join(sizes.withColumnsRenamed({"owner": "_owner", "version": "_version"}), ["_owner", "_version"], "left")
    starts = F.lit(None).cast("array<int>")
    if passage_words:
        again = passages(docs.select(key.alias("owner"), F.xxhash64(text).alias("version"), F.col(text).alias("text")), passage_words)
        joined = joined.join(again.select(F.col("owner").alias("_owner"), F.col("version").alias("_version"), F.col("starts").alias("_starts")), ["_owner", "_version"], "left")
        starts = F.col("_starts")

    def rebuilt(c: Column) -> Column:
        gone = F.map_from_entries(F.transform(F.array_distinct(F.coalesce("_nos", F.array().cast("array<int>"))), lambda x: F.struct(x, F.lit(True))))
        kept = F.when(F.col("_nos").isNull(), F.col(text)).otherwise(let(gone, lambda g: F.array_join(F.flatten(F.filter(c, lambda x, i: g[i].isNull())), "")))
        own = let(gone, lambda g: F.struct(*(x.alias(name) for x, name in zip(_without(F.col(text), c, g, starts, passage_words or 0), ("text_own", "n_passages")))))
        return F.struct(kept.alias("text_kept"), F.when(starts.isNotNull(), own).alias("own"))

    whole = F.struct(F.col(text).alias("text_kept"), F.lit(None).cast("struct<text_own:string,n_passages:int>").alias("own"))
    out = joined.withColumn("_r", F.when(F.col("_nos").isNull() & starts.isNull(), whole).otherwise(let(chunks(F.col(text), long_words), rebuilt)))
    more = [F.coalesce("_r.own.text_own", "_r.text_kept").alias("text_own"), F.coalesce("_r.own.n_passages", F.lit(0)).alias("n_passages")] if passage_words else []
    return out.select(*[out[c] for c in base.columns], "_r.text_kept", F.col("_n_lines").alias("n_lines"), F.col("_n_chunks").alias("n_chunks"), F.coalesce(F.size("_nos"), F.lit(0)).alias("n_removed"),
                      F.coalesce(F.length(text) - F.length("_r.text_kept"), F.lit(0)).alias("removed_chars"), *more)
