"""Benchmark decontamination by winnowed fingerprints that are extended to verified spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import alnum_words, gram_hashes, word_hashes

#: Words of a window, of a gram, and grams of a window. Any shared window of 10 words has the same
#: 6 grams on both sides, hence the same least gram: no shared span of 10 words goes unseen.
SPAN, GRAM = 10, 5
GUARD = SPAN - GRAM
#: Ids of up to so many documents are broadcast (some 50 MB).
BROADCAST_ROWS = 1_000_000


def fingerprints(words: DataFrame, keep: list[str]) -> DataFrame:
    """Winnowing: the starts ``at`` of the grams that are the least of some window of a text (column h, the hashes of its
    words), with their hashes ``own``; all of them on ties. A row with ``at`` null stands for the text itself.

    A gram is the least of one of its windows if it equals the greatest of their least grams. There is
    no ``slice`` here: inside a lambda it would copy the whole array for each element. Texts are not kept
    beside their grams, of which each would hold a copy.
    """
    around = lambda x, at, js: [F.get(x, at + j) for j in js]
    d = words.select(*keep, gram_hashes("h", GRAM).alias("g"))
    d = d.withColumn("least", F.when(F.size("g") > GUARD, F.transform(F.sequence(F.lit(0), F.size("g") - (GUARD + 1)), lambda p: F.least(*around("g", p, range(GUARD + 1))))))
    marked = F.transform("g", lambda x, i: F.when(F.greatest(*around("least", i, range(-GUARD, 1))) == x, F.struct(i.alias("at"), x.alias("own"))))
    picks = F.when(F.size("g") > GUARD, F.filter(marked, lambda x: x.isNotNull()))
    none = F.lit(None).cast("struct<at:int,own:bigint>")
    d = d.select(*keep, F.concat(F.array(none), F.coalesce(picks, F.array().cast("array<struct<at:int,own:bigint>>"))).alias("picks"))
    return d.select(*keep, F.explode_outer("picks").alias("pick")).select(*keep, "pick.at", "pick.own")


def _run_length(flags: Column, n: int) -> Column:
    """How many of the ``n`` flags are true before the first that is not."""
    first = F.array_position(flags, False)
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def find_overlaps(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_rows: int = 200_000) -> DataFrame:
    """Words of documents that stand in a window of a benchmark item.

    A window is 10 consecutive words of an item; an item of fewer words is one window as a whole.
    Fingerprints of the items are broadcast, at most ``block_rows`` at once: they are counted first,
    and a larger benchmark is taken in as many blocks of items, each with its own pass. They carry the
    number of a set of items, not the items, since a common opening may belong to all of them. A
    fingerprint that both sides have is extended word by word to the left and right; a run of 10 words
    or more is a hit. Items of fewer than 10 words are looked up by the hash of the whole item, all
    lengths in one pass, and compared.

    One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.
    Null text has no words; an item without words has no window; null item ids are left out of
    n_items, but their words still count as hit. Rows that agree in id and text give the same result
    as often as they occur. Other columns are not carried.
    """
    c, key, scratch = F.col, ["doc_id", "text_hash"], Scratch(docs.sparkSession, "decontaminate")
    w = items.select(c(item_col).cast("string").alias("item"), alnum_words(c(item_text_col).cast("string")).alias("w")).groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items"))
    w = w.withColumn("h", word_hashes(c("w"))).withColumn("n", F.size("w")).where("n > 0")
    long = fingerprints(w.where(c("n") >= SPAN), ["w", "items"]).where(c("at").isNotNull())
    # The words around a gram; those beyond the ends of the item are null.
    offsets = F.array(*[F.lit(j) for j in range(-GUARD, SPAN)])
    long = long.select(c("own").alias("gram"), F.transform(offsets, lambda j: F.get("w", c("at") + j)).alias("phrase"), "items")
    long = long.groupBy("gram", "phrase").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    short = w.where(c("n") < SPAN)
    whole = F.coalesce(*[F.when(c("n") == k, F.get(gram_hashes("h", k), F.lit(0))) for k in range(1, SPAN)])
    short = short.select(whole.alias("gram"), c("w").alias("phrase"), "items")
    known = scratch.write(long.withColumn("short", F.lit(False)).unionByName(short.withColumn("short", F.lit(True))).withColumn("set_id", F.xxhash64("items")), "items")
    sets = known.groupBy("set_id").agg(F.first("items").alias("items"))
    known = known.drop("items")
    size = known.select(F.count(F.when(~c("short"), 1)), F.count(F.when(c("short"), 1)), F.collect_set(F.when(c("short"), F.size("phrase")))).head()
    lengths = sorted(size[2])

    def blocks(table: DataFrame, rows: int) -> list[DataFrame]:
        n = max(1, -(-rows // block_rows))
        return [table if n == 1 else table.where(F.pmod(F.xxhash64("gram"), F.lit(n)) == b) for b in range(n)]

    d = docs.select(c(id_col).alias("doc_id"), F.xxhash64(c(text_col)).alias("text_hash"), alnum_words(c(text_col).cast("string")).alias("w"))
    h = d.select(*key, word_hashes(c("w")).alias("h"), F.size("w").alias("n"))
    placed = lambda k: F.transform(gram_hashes("h", k), lambda x, i: F.struct(i.alias("at"), F.lit(k).alias("k"), x.alias("own")))
    # First the places of fingerprints that both sides have, without any text; and a row for each text.
    found = []
    for b, part in enumerate(blocks(known.where("not short"), size[0])):
        f = fingerprints(h, [*key, "n"])
        if b:
            f = f.where(c("at").isNotNull())
        f = f.join(F.broadcast(part), c("own") == c("gram"), "left").where(c("gram").isNotNull() | c("at").isNull())
        found.append(f.select(*key, "n", "at", "set_id", "phrase", "short"))
    for part in blocks(known.where("short"), size[1]) if lengths else []:
        f = h.select(*key, F.concat(*[placed(k) for k in lengths]).alias("grams")).select(*key, F.explode_outer("grams").alias("x")).select(*key, "x.*")
        f = f.join(F.broadcast(part), (c("own") == c("gram")) & (c("k") == F.size("phrase")))
        found.append(f.select(*key, F.lit(None).cast("int").alias("n"), "at", "set_id", "phrase", "short"))
    places = found[0]
    for f in found[1:]:
        places = places.unionByName(f)
    places = scratch.write(places, "places")
    # Then the words of the texts that have any: they are read again, and no other text moves.
    asked = places.where(c("at").isNotNull()).groupBy(*key).agg(F.collect_set(F.struct("at", "set_id", "phrase", "short")).alias("hits")).withColumnsRenamed({"doc_id": "i", "text_hash": "t"})
    asked = scratch.write(asked, "asked")
    same_text = c("doc_id").eqNullSafe(c("i")) & (c("text_hash") == c("t"))
    few = asked.select("i", "t")
    near = docs.select(c(id_col).alias("doc_id"), F.xxhash64(c(text_col)).alias("text_hash"), c(text_col).cast("string").alias("text"))
    near = near.join(F.broadcast(few) if asked.count() <= BROADCAST_ROWS else few, same_text, "left_semi")
    f = near.join(asked, same_text).select(*key, alnum_words(c("text")).alias("w"), "hits")

    def extended(x: Column) -> Column:
        """Where the words around a place agree with the item's, and how far."""
        same = F.transform(x["phrase"], lambda y, j: F.coalesce(y == F.get("w", x["at"] + j - F.when(x["short"], 0).otherwise(GUARD)), F.lit(False)))
        left = _run_length(F.reverse(F.slice(same, 1, GUARD)), GUARD)
        right = _run_length(F.slice(same, SPAN + 1, GUARD), GUARD)
        grown = F.when(~F.array_contains(F.slice(same, GUARD + 1, GRAM), False), F.struct((x["at"] - left).alias("start"), (x["at"] + GRAM + right).alias("stop"), x["set_id"].alias("set_id")))
        equal = F.when(~F.array_contains(same, False), F.struct(x["at"].alias("start"), (x["at"] + F.size(same)).alias("stop"), x["set_id"].alias("set_id")))
        return F.when(x["short"], equal).when(grown["stop"] - grown["start"] >= SPAN, grown)

    f = f.select(*key, F.filter(F.transform("hits", extended), lambda x: x.isNotNull()).alias("spans")).select(*key, F.explode_outer("spans").alias("s")).where(c("s").isNotNull())
    f = f.select(*key, F.lit(None).cast("int").alias("n"), F.lit(0).cast("long").alias("self"), "s.set_id", "s.start", "s.stop")
    blank = F.lit(None).cast("int")
    texts = places.where(c("at").isNull()).select(*key, "n", F.lit(1).cast("long").alias("self"), F.lit(None).cast("long").alias("set_id"), blank.alias("start"), blank.alias("stop"))
    found = texts.unionByName(f)
    # First by distinct span, so that a passage of many items counts once; then by document.
    found = found.groupBy(*key, "start", "stop").agg(F.max("n").alias("n"), F.sum("self").alias("copies"), F.collect_set("set_id").alias("sets"))
    out = found.groupBy(*key).agg(F.max("n").cast("long").alias("n_words"), F.max("copies").cast("int").alias("copies"), F.sort_array(F.collect_set(F.when(c("start").isNotNull(), F.struct("start", "stop")))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("sets"))).alias("sets"))
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("total"))

    def add(acc: Column, s: Column) -> Column:
        fresh = F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["upto"]))
        return F.struct(F.greatest(acc["upto"], s["stop"]).alias("upto"), (acc["total"] + fresh).alias("total"))

    out = scratch.write(out.select(*key, "n_words", "copies", "sets", F.aggregate("spans", zero, add)["total"].alias("n_hit")), "hits")
    # Items of the documents that have hits; the lists of items come in only here.
    named = out.where(F.size("sets") > 0).select(*key, F.explode("sets").alias("set_id")).join(sets, "set_id").select(*key, F.explode("items").alias("item"))
    named = named.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items")).withColumnsRenamed({"doc_id": "i", "text_hash": "t"})
    out = out.join(named, c("doc_id").eqNullSafe(c("i")) & c("text_hash").eqNullSafe(c("t")), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    out = out.withColumn("copies", F.explode_outer(F.sequence(F.lit(1), c("copies"))))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (c("n_hit") > 0).alias("contaminated"))
