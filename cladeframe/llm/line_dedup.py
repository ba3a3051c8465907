"""Line dedup: by content-defined chunks of lines, and by whole repeated runs of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: One line in so many starts a chunk.
MEAN_LINES = 3


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("long") % 1000003


def _starts(lines: Column, x: Column, i: Column, mean_lines: int) -> Column:
    """Whether a line of ``lines``, with hashes, starts a chunk."""
    return (i == 0) | ((F.get(lines, i - 1)["h"] * 31 + x["h"]) % mean_lines == 0)


def chunks(text: Column, mean_lines: int = MEAN_LINES) -> Column:
    """Chunks of a text, in order. A chunk starts where the rolling hash over a line and the one before
    is divisible by ``mean_lines``, so that text before a passage does not move the boundaries in it.

    Each line carries a mark, 1 where it starts a chunk and else 0; ``unmarked`` takes the marks off.
    """
    hashed = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), _line_hash(x).alias("h")))
    hashed_col = F.col("_lines")
    marked = F.transform(hashed_col, lambda x, i: F.concat(F.when(_starts(hashed_col, x, i, mean_lines), "1").otherwise("0"), x["line"]))
    return hashed, F.split(F.array_join(marked, "\n"), "\n(?=1)")


def unmarked(parts: Column) -> Column:
    return F.regexp_replace(F.array_join(parts, "\n"), r"(?:(?<=\n)|^)[01]", "")


def _rest(docs: DataFrame, text_col: str, counts: tuple[str, str]) -> Column:
    """All other columns as one, so that no name can clash with those used here."""
    names = [x for x in docs.columns if x != text_col and x not in counts]
    return (F.struct(*[F.col(f"`{x}`") for x in names]) if names else F.lit(None)).alias("row")


def _finished(docs: DataFrame, out: DataFrame, text_col: str, text: Column, counts: tuple[str, str], n_lines: Column, n_removed: Column) -> DataFrame:
    """The columns of ``docs``, with the text cut, and the counts."""
    own = [text.alias(x) if x == text_col else F.col("row")[x].alias(x) for x in docs.columns if x not in counts]
    return out.select(*own, n_lines.alias(counts[0]), n_removed.alias(counts[1]))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mean_lines: int = MEAN_LINES, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """Remove chunks of two or more lines that stand elsewhere too.

    Of the places of a chunk the first stays, by id (null first), text hash and position; the chunk is
    removed from all others. Chunks are compared by SHA-256, so that no text is moved for it. Chunks of one line,
    or without any word, stay.

    One row for each row of ``docs`` with all its columns, ``text`` cut, and ``counts``: lines, and lines removed. A
    column of ``docs`` with the name of a count is replaced by it; no other name clashes.
    A null text stays null, with 0 lines. Rows that agree in id and text count as one document and get
    the same result. A text whose chunks are all removed becomes empty.
    """
    c, key = F.col, ["_i", "_h"]
    d = docs.select(c(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), _rest(docs, text_col, counts), c(text_col).alias("whole"))
    hashed, parts = chunks(c("_text"), mean_lines)
    cut = lambda x: x.withColumn("_lines", hashed).withColumn("_parts", parts).drop("_lines")
    own = cut(docs.select(c(id_col).alias("_i"), F.xxhash64(text_col).alias("_h"), c(text_col).alias("_text"))).select(*key, F.posexplode_outer("_parts").alias("at", "chunk"))
    own = own.where(c("chunk").contains("\n") & c("chunk").rlike(r"(?:^|\n)[01][^\n]*[^\x20\x09-\x0D]"))
    own = own.select(F.unhex(F.sha2("chunk", 256)).alias("chunk_id"), F.struct(*key, "at").alias("place"))
    again = own.groupBy("chunk_id").agg(F.min("place").alias("first"), F.max("place").alias("last")).where(c("first") != c("last")).select("chunk_id", "first")
    gone = own.select("chunk_id", "place").join(again, "chunk_id").where(c("place") != c("first"))
    gone = gone.select("place.*").groupBy(*key).agg(F.collect_set("at").alias("_gone"))
    out = d.join(gone, c("_id").eqNullSafe(c("_i")) & (c("_hash") == c("_h")), "left")
    lines = lambda parts: F.when(F.size(parts) > 0, F.size(F.split(F.array_join(parts, "\n"), "\n"))).otherwise(0)
    # Only texts that lose a chunk are cut again. The row itself is one column meanwhile.
    out = cut(out.select("row", "whole", "_gone", F.when(c("_gone").isNotNull(), c("whole")).alias("_text")))
    out = out.withColumn("_kept", F.filter("_parts", lambda x, i: ~F.array_contains("_gone", i)))
    total = F.when(c("whole").isNull(), 0).otherwise(F.char_length("whole") - F.char_length(F.replace(c("whole"), F.lit("\n"), F.lit(""))) + 1)
    n_lines, n_removed = total.cast("long"), F.when(c("_gone").isNotNull(), total - lines(c("_kept"))).otherwise(0).cast("long")
    text = F.when(c("_gone").isNotNull(), unmarked(c("_kept"))).otherwise(c("whole"))
    return _finished(docs, out, text_col, text, counts, n_lines, n_removed)


#: A break before a line that has a word; blank lines stay with the line before them.
WORDED = r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"


def dedup_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mean_lines: int = MEAN_LINES, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """Remove every line of the runs of two or more lines that stand elsewhere too, whatever lies around them.

    Content-defined chunks of lines go first, as in ``dedup_lines``: of the places of a chunk of two or more lines all but
    the first. What the chunks' boundaries hide is then looked for among all neighbours that are not both in a
    chunk that goes. A run repeats if each two neighbouring lines of it do, so no boundary can hide a part of it. Blank
    lines go with the line before them. Of the places of two neighbours the first stays, by id (null first), text hash
    and position; those of all others go. (A chunk's places are in the order of those of its neighbours, so it makes
    no difference that these were not looked at.) A line that goes has an equal one at an earlier place, so each
    different line of the corpus stays at one place at least. Single lines, and texts without any word, stay.
    Chunks and neighbours are compared by SHA-256, and of a text only these hashes move.

    Rows and columns are those of ``dedup_lines``. A text of which no word is left becomes empty.
    """
    c, key, scratch = F.col, ["_i", "_h"], Scratch(docs.sparkSession, "lines")
    worded = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    digest = lambda x: F.unhex(F.sha2(x, 256))
    d = docs.select(c(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), _rest(docs, text_col, counts), c(text_col).alias("whole"))
    hashed = F.transform(F.split(text_col, WORDED), lambda x: F.struct(x.alias("line"), _line_hash(x).alias("h")))
    lines = docs.select(c(id_col).alias("_i"), F.xxhash64(text_col).alias("_h"), hashed.alias("_lines"))
    # A chunk has the number of its first line before it. Blank lines cannot be taken for a mark.
    first = lambda i: F.concat(F.lit("1"), i.cast("string"), F.lit("\t"))
    marked = F.transform("_lines", lambda x, i: F.concat(F.when(_starts(c("_lines"), x, i, mean_lines), first(i)).otherwise("0"), x["line"]))
    parts = F.split(F.array_join(marked, "\n"), "\n(?=1)")
    own = F.transform(parts, lambda x: F.struct(F.substr(F.substring_index(x, "\t", 1), F.lit(2)).cast("int").alias("at"), digest(F.substr(x, F.locate("\t", x) + 1)).alias("chunk")))
    # The line after is compared without its blank lines; a line with blank lines is a run by itself.
    after = lambda i: F.substring_index(F.get("_lines", i + 1)["line"], "\n", 1)
    pairs = F.transform("_lines", lambda x, i: F.when(i + 1 < F.size("_lines"), digest(F.concat(x["line"], F.lit("\n"), after(i)))))
    alone = F.transform("_lines", lambda x, i: F.when(F.contains(x["line"], F.lit("\n")) & worded(x["line"]), digest(x["line"])))
    known = scratch.write(lines.select(*key, own.alias("chunks"), pairs.alias("pairs"), alone.alias("alone")), "hashes")

    def repeated(found: DataFrame, name: str) -> DataFrame:
        """Places (_i, _h, at, n) but the first of what has several."""
        found = found.select(name, "n", F.struct(*key, "at").alias("place"))
        again = found.groupBy(name).agg(F.min("place").alias("first"), F.max("place").alias("last")).where(c("first") != c("last")).select(name, "first")
        return found.join(again, name).where(c("place") != c("first")).select("place.*", "n")

    sized = F.transform("chunks", lambda x, k: F.struct(x["chunk"].alias("chunk"), x["at"].alias("at"), (F.coalesce(F.get("chunks", k + 1)["at"], F.size("pairs")) - x["at"]).alias("n")))
    whole = known.select(*key, sized.alias("chunks")).select(*key, F.explode_outer("chunks").alias("x")).select(*key, "x.*").where("n > 1")
    whole = scratch.write(repeated(whole, "chunk").distinct(), "chunks")
    spans = whole.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("spans")).withColumnsRenamed({"_i": "_id", "_h": "_hash"})
    # Each line has a mark: 2 if it goes with the one after it in a chunk, 1 if it is the last of a chunk that goes.
    end = lambda k: F.coalesce(F.get("spans", k - 1)["at"] + F.get("spans", k - 1)["n"], F.lit(0))
    marks = F.transform("spans", lambda x, k: F.concat(F.repeat(F.lit("0"), x["at"] - end(k)), F.repeat(F.lit("2"), x["n"] - 1), F.lit("1")))
    rest = known.drop("chunks").join(spans, c("_i").eqNullSafe(c("_id")) & (c("_h") == c("_hash")), "left").withColumn("marks", F.split(F.array_join(marks, ""), ""))
    mark = lambda i: F.coalesce(F.get("marks", i), F.lit("0"))
    pairs = F.transform("pairs", lambda x, i: F.when(mark(i) != "2", x))
    alone = F.transform("alone", lambda x, i: F.when(mark(i) == "0", x))
    runs = rest.select(*key, F.explode_outer(F.array(F.struct(F.lit(2).alias("n"), pairs.alias("ids")), F.struct(F.lit(1).alias("n"), alone.alias("ids")))).alias("x"))
    runs = runs.select(*key, c("x.n").alias("n"), F.posexplode_outer("x.ids").alias("at", "run")).where(c("run").isNotNull())
    gone = repeated(runs, "run").unionByName(whole)
    gone = gone.select(*key, F.explode(F.sequence(c("at"), c("at") + c("n") - 1)).alias("line"))
    gone = gone.groupBy(*key).agg(F.sort_array(F.collect_set("line")).alias("_gone"))
    out = d.join(gone, c("_id").eqNullSafe(c("_i")) & (c("_hash") == c("_h")), "left")
    # One mark for each line up to the last that goes, so that no line is sought in a list.
    marks = F.transform("_gone", lambda x, k: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get("_gone", k - 1), F.lit(-1)) - 1), F.lit("1")))
    out = out.withColumn("_marks", F.split(F.array_join(marks, ""), ""))
    out = out.withColumn("_lines", F.when(c("_gone").isNotNull(), F.split("whole", WORDED)))
    out = out.withColumn("_left", F.array_join(F.filter("_lines", lambda x, i: F.coalesce(F.get("_marks", i), F.lit("0")) == "0"), "\n"))
    breaks = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit("\n"), F.lit("")))
    total = F.when(c("whole").isNull(), 0).otherwise(breaks(c("whole")) + 1)
    left = F.when(worded(c("_left")), breaks(c("_left")) + 1).otherwise(0)
    n_removed = F.when(c("_gone").isNotNull(), total - left).otherwise(0).cast("long")
    text = F.when(c("_gone").isNull(), c("whole")).when(worded(c("_left")), c("_left")).otherwise("")
    return _finished(docs, out, text_col, text, counts, total.cast("long"), n_removed)
