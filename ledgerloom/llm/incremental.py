"""Deduplicating new batches against all history (problem 5).

A notice repeats an earlier one if its address leads to the same page, if its content hash is one
that an earlier notice had, or if its text shares at least half of its sentences (Jaccard of
normalised sentences, page furniture apart) and at least two of them, or all.

Texts are compared by an inverted index of rare-token prefixes. A token is the hash of a sentence;
rare tokens come first. Two sets with Jaccard of at least T share ceil(T n) tokens, so they share a
token among the first n - ceil(T n) + 1 of either: only these are posted. A token that more than HOT
texts post would make a long posting list; texts post it together with each other token of the
prefix longer by one, of which such a pair shares two, so nothing is lost and lists stay short. Equal
sets are first taken as one by their hash, so copies of one text, however many, post once: of each
set only one text of the first batch that holds it.

``repeats`` indexes all notices at once and orders tokens by document frequency. The stored index
(``HistoryIndex``) can't know the frequencies to come, so it orders tokens by two classes, rare and
hot, and by hash in each; a token becomes hot once, when its posting list with the batch's texts grows
beyond HOT. Only the texts in that one list have it in their prefix, so only they are posted anew.
Exact keys, postings, token sets, hot tokens and the sites' line counts lie in tables partitioned by a
bucket of their key and are only appended to. A batch looks its own keys up in the buckets they
fall in (a small batch by the keys themselves), fetches the sets of candidates alone, and takes page
furniture from the line counts of the history so far, itself included.

SCALE: two sentences' worth of lists bounds a key's group unless very many different texts share
the same two frequent sentences in their prefixes; such texts are near-duplicates of each other for
the most part.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from . import boilerplate
from .support import BLANKS, checkpointed

THRESHOLD = 0.5
HOT = 50
BUCKETS = 16  # partitions of a table; a larger history takes more
FEW = 200  # notices of a batch up to which its keys are pushed to the scans of the stored tables
BATCHES = 4  # of the query; every batch costs the same few dozen steps, whatever its size
#: Parameters of addresses that don't choose the page.
TRACKING = r"^(?:utm_.*|_t|_|t|ts|from|spm|share.*|source|ref|timestamp|scene|isappinstalled)$"
_WIDE = "".join(chr(c) for c in range(0xFF10, 0xFF1A)) + "".join(chr(c) for c in range(0xFF21, 0xFF3B)) + "".join(chr(c) for c in range(0xFF41, 0xFF5B))
_THIN = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)


def page_of(url: Column) -> Column:
    """One form of the addresses of one page; null and blank stay null."""
    whole = F.btrim(url, F.lit(BLANKS))
    bare = F.regexp_replace(whole, "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?i:https?:)?//([^/?#]*)", 1))
    host = F.regexp_replace(host, r":(?:80|443)$", "")
    rest = F.regexp_replace(bare, r"^(?i:https?:)?//[^/?#]*", "")
    path = F.regexp_replace(F.regexp_replace(F.split_part(rest, F.lit("?"), F.lit(1)), r"/(?:\./)+", "/"), "/{2,}", "/")
    query = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    query = F.array_sort(F.filter(query, lambda q: (q != "") & ~F.regexp_replace(q, "=.*$", "").rlike(TRACKING)))
    return F.when(whole != "", F.concat_ws("?", F.concat(host, F.regexp_replace(path, "/$", "")), F.array_join(query, "&")))


def sentences(text: Column) -> Column:
    """array<array<long>>: for each line the hashes of its sentences, letters and digits only."""
    folded = F.regexp_replace(F.lower(F.translate(text, _WIDE, _THIN)), r"[^\p{L}\p{N}\n。]+", "")
    return F.transform(F.split(folded, "\n"), lambda line: F.transform(F.filter(F.split(line, "。"), lambda x: x != ""), lambda x: F.xxhash64(x)))


def prepared(notices: DataFrame) -> DataFrame:
    """(id, page, source, lines, cut, longest) of notices, each row by itself: their pages, and the hashes of lines and sentences.

    ``lines``, ``cut`` and ``longest`` (the longest line's identifier) are null for a null or empty text.
    """
    text = F.when(F.col("raw_text") != "", F.col("raw_text"))
    lengths = F.transform(F.split(text, "\n"), lambda x: F.length(x))
    rows = notices.select("id", page_of(F.col("url")).alias("page"), F.coalesce("source_site", F.lit("")).alias("source"), boilerplate.line_keys(text).alias("lines"), sentences(text).alias("cut"), F.array_position(lengths, F.array_max(lengths)).cast("int").alias("at"))
    return rows.select("id", "page", "source", "lines", "cut", F.element_at("lines", F.col("at")).alias("longest"))


def kept_tokens(rows: DataFrame, often: DataFrame) -> DataFrame:
    """(id, tokens): distinct sentence hashes of each text without its site's furniture. often: (source, often array<long>), at most 20 lines for every line of a mean text."""
    kept = F.filter(F.arrays_zip("lines", "cut"), lambda x: x["lines"].isNotNull() & ~F.coalesce(F.array_contains(F.col("often"), x["lines"]), F.lit(False)))
    tokens = F.array_sort(F.array_distinct(F.flatten(F.transform(kept, lambda x: x["cut"]))))
    return rows.filter("lines is not null").join(F.broadcast(often), "source", "left").select("id", tokens.alias("tokens")).filter(F.size("tokens") > 0)


def token_sets(notices: DataFrame) -> DataFrame:
    """(id, tokens): distinct sentence hashes of each text without the lines its site repeats.

    A line counts as repeated here by the number of different longest lines beside it, one text for
    each: many copies of one text, even slightly edited ones, don't make its own lines furniture.
    """
    rows = checkpointed(prepared(notices).drop("page"))
    named = rows.filter("source <> '' and lines is not null")
    firsts = named.groupBy("source", "longest").agg(F.min("id").alias("id")).select("id")
    counted = named.select("id", "source", "lines").join(firsts, "id", "left_semi")
    return kept_tokens(rows, checkpointed(boilerplate.frequent_lines(counted, boilerplate.support_needed(counted)).groupBy("source").agg(F.collect_set("line").alias("often"))))


def same_key(keyed: DataFrame) -> DataFrame:
    """(a, b) links from each id to the smallest id with the same key. keyed: (key, id)."""
    least = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("key", "a")
    return keyed.join(least, "key").filter("id > a").select("a", F.col("id").alias("b"))


def exact_keys(pages: DataFrame, hashes: DataFrame) -> DataFrame:
    """(key, id) of pages and contents; keys are 96-bit hashes. pages: (id, page)."""
    pages = pages.select(F.concat(F.lit("u"), "page").alias("k"), "id")
    contents = hashes.filter("content_hash <> ''").select(F.concat(F.lit("h"), "content_hash").alias("k"), F.col("notice_id").alias("id")).distinct()
    return pages.unionByName(contents).filter("k is not null").select(F.struct(F.xxhash64("k").alias("x"), F.hash("k").alias("h")).alias("key"), "id")


def frequencies(sets: DataFrame) -> DataFrame:
    """(token, n) of tokens in two sets or more; all others are rarer."""
    return sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")


def posting_keys(hot: int) -> Column:
    """array<struct<key, second>> of a text from its columns ``size`` and ``p``, the listed tokens (n, token) in order."""
    # tokens left out are the rarest, so they come before all listed ones
    missing = F.col("size") - F.size("p")
    first = F.col("size") - F.ceil(THRESHOLD * F.col("size")) + 1 - missing
    single = F.filter(F.slice("p", 1, F.greatest(first, F.lit(0))), lambda x: x["n"] <= hot)
    often = F.filter(F.slice("p", 1, F.greatest(first, F.lit(0))), lambda x: x["n"] > hot)
    longer = F.slice("p", 1, F.greatest(first + 1, F.lit(0)))
    pairs = F.flatten(F.transform(often, lambda h: F.transform(F.filter(longer, lambda x: x["token"] != h["token"]), lambda x: F.struct(F.least(h["token"], x["token"]).alias("key"), F.greatest(h["token"], x["token"]).alias("second")))))
    return F.concat(F.transform(single, lambda x: F.struct(x["token"].alias("key"), F.lit(0).cast("long").alias("second"))), F.array_distinct(pairs))


def postings(sets: DataFrame, order: DataFrame) -> DataFrame:
    """(key, second, id, size): prefix postings; second is 0 for a rare token, else the other token of a pair.

    order: (token, n); tokens it lacks are in no other set and aren't posted.
    """
    rows = sets.select("id", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(order, "token")
    ranked = rows.groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("p"))
    return ranked.select("id", "size", F.explode(posting_keys(HOT)).alias("k")).select("k.key", "k.second", "id", "size")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of the candidate pairs whose sets are near-duplicates. left, right: (id, tokens)."""
    both = pairs.join(left.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(right.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - shared
    return both.filter(((shared >= 2) & (shared >= THRESHOLD * union)) | (shared == union)).select("a", "b")


def near_links(sets: DataFrame, order: DataFrame) -> DataFrame:
    """(a, b) links within one batch; sets: (id, tokens) with distinct token sets."""
    posted = postings(sets, order)
    a, b = posted.alias("a"), posted.alias("b")
    fits = (F.least("a.size", "b.size") >= THRESHOLD * F.greatest("a.size", "b.size")) & (F.col("a.id") < F.col("b.id"))
    pairs = a.join(b, ["key", "second"]).filter(fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    return verified(checkpointed(pairs), sets, sets)


def repeats(notices: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id_a, id_b): each notice that repeats an earlier one, with the earliest of its group.

    notices: (id, url, source_site, raw_text); hashes: (notice_id, content_hash). Null addresses,
    hashes and texts match nothing; rows given twice are one notice; an empty table gives an empty
    result.
    """
    sets = checkpointed(token_sets(notices))
    keyed = sets.select(F.struct(F.xxhash64("tokens").alias("x"), F.hash("tokens").alias("h")).alias("key"), "id")
    one = sets.join(keyed.groupBy("key").agg(F.min("id").alias("id")), "id", "left_semi")
    links = same_key(exact_keys(notices.select("id", page_of(F.col("url")).alias("page")), hashes)).unionByName(same_key(keyed)).unionByName(near_links(one, frequencies(one)))
    return components(links).filter("node <> root").select(F.col("root").alias("id_a"), F.col("node").alias("id_b"))


#: Stored tables: their columns and the one whose hash is the bucket.
TABLES = {
    "keys": ("x long, h int, id long", "x"),  # an exact key with the first notice that had it
    "sets": ("id long, tokens array<long>", "id"),  # of one notice for each distinct set
    "postings": ("key long, second long, id long, size int", "key"),
    "hot": ("token long", "token"),
    "longest": ("mark long", "mark"),  # (source, longest line) of the texts whose lines are counted
    "lines": ("mark long, source string, line long, n long", "mark"),  # counts by batch; line 0 counts the source's texts
    "links": ("a long, b long", "b"),
}


class HistoryIndex:
    """The accepted history as tables under one path, only appended to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._writes: list[tuple[str, DataFrame]] = []

    def _finish(self) -> None:
        """Append all that a batch brought, each table in a job of its own beside the others."""
        tables: dict[str, DataFrame] = {}
        for name, rows in self._writes:  # one job a table: appends to one folder at a time would share temporary files
            rows = rows.select(*(c.split(" ")[0] for c in TABLES[name][0].split(", ")))
            tables[name] = tables[name].unionByName(rows) if name in tables else rows
        with ThreadPoolExecutor(len(TABLES)) as pool:
            for done in [pool.submit(self.append, *w) for w in tables.items()]:
                done.result()
        self._writes = []

    def _has(self, name: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def stored(self, name: str) -> DataFrame:
        columns, _ = TABLES[name]
        if not self._has(name):
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(f"{columns}, bucket int").parquet(f"{self.path}/{name}")

    def found(self, name: str, wanted: DataFrame, few: bool) -> DataFrame:
        """The rows of a table with a wanted key. wanted: one column, distinct. few: the keys are pushed to the scan, buckets and all."""
        columns, key = TABLES[name]
        if not self._has(name):
            return self.spark.createDataFrame([], columns)
        wanted = wanted.toDF(key)
        rows = self.stored(name)
        if few:
            each = wanted.select(key, self.bucket(key)).collect()
            rows = rows.filter(F.col("bucket").isin(sorted({r[1] for r in each})) & F.col(key).isin([r[0] for r in each]))
        else:
            rows = rows.join(wanted, key, "left_semi")
        return rows.drop("bucket")

    @staticmethod
    def bucket(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")

    def append(self, name: str, rows: DataFrame) -> None:
        columns, key = TABLES[name]
        typed = rows.select(*(F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in columns.split(", ")))
        typed.select("*", self.bucket(key)).repartition("bucket").sortWithinPartitions("bucket", key).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def token_sets(self, rows: DataFrame, few: bool) -> DataFrame:
        """(id, tokens) of prepared rows, furniture by the counts of all lines so far; the batch's own are counted first."""
        named = rows.filter("source <> '' and lines is not null").withColumn("mark", F.xxhash64("source", "longest"))
        firsts = named.groupBy("mark").agg(F.min("id").alias("id"))
        firsts = checkpointed(firsts.join(self.found("longest", firsts.select("mark"), few), "mark", "left_anti"))
        lines = F.array_distinct(F.array_compact(F.col("lines")))
        counted = named.join(firsts.select("id"), "id", "left_semi").select("source", F.explode(F.concat(lines, F.array(F.lit(0).cast("long")))).alias("line"))
        counted = checkpointed(counted.groupBy("source", "line").agg(F.count("*").alias("n")).select(F.xxhash64("source", "line").alias("mark"), "source", "line", "n"))
        held = named.select("source", F.explode(F.concat(lines, F.array(F.lit(0).cast("long")))).alias("line")).distinct().select(F.xxhash64("source", "line").alias("mark"))
        total = self.found("lines", held, few).unionByName(counted).groupBy("source", "line").agg(F.sum("n").alias("n"))
        least = F.greatest(F.lit(boilerplate.MIN_DOCUMENTS), F.ceil(F.col("n") / boilerplate.MIN_SHARE))
        # one row a source: its least count, and the lines that reach it
        total = total.filter((F.col("n") >= boilerplate.MIN_DOCUMENTS) | (F.col("line") == 0)).groupBy("source").agg(F.max(F.when(F.col("line") == 0, least)).alias("least"), F.collect_list(F.struct("line", "n")).alias("l"))
        often = total.select("source", F.transform(F.filter("l", lambda x: (x["line"] != 0) & (x["n"] >= F.col("least"))), lambda x: x["line"]).alias("often"))
        sets = checkpointed(kept_tokens(rows, often))
        self._writes.append(("longest", firsts))
        self._writes.append(("lines", counted))
        return sets

    def add(self, notices: DataFrame, hashes: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Take a batch in: (id_a, id_b), each of its notices that repeats an accepted one or one of the batch, with the least one it was met with.

        notices: (id, url, source_site, raw_text) or rows of ``prepared``; hashes: (notice_id,
        content_hash). sets: (id, tokens) of the batch, by default made from its texts with the
        line counts of the history so far. ``groups`` joins the links of all batches.
        """
        rows = checkpointed(notices if "cut" in notices.columns else prepared(notices))
        few = rows.count() <= FEW
        sets = self.token_sets(rows, few) if sets is None else checkpointed(sets)
        text_keys = sets.select(F.struct(F.xxhash64("tokens").alias("x"), F.hash("tokens").alias("h")).alias("key"), "id")
        keys = checkpointed(exact_keys(rows, hashes).withColumn("text", F.lit(False)).unionByName(text_keys.withColumn("text", F.lit(True))).select("key.x", "key.h", "id", "text"))
        # of each key the first notice that had it, in history before the batch
        old = self.found("keys", keys.select("x").distinct(), few)
        least = keys.withColumn("new", F.lit(True)).unionByName(old.select("x", "h", "id", F.lit(False).alias("text"), F.lit(False).alias("new")))
        least = checkpointed(least.groupBy("x", "h").agg(F.min(F.struct("new", "id")).alias("m"), F.bool_or("text").alias("text")).select("x", "h", "m.new", F.col("m.id").alias("a"), "text"))
        links = keys.join(least.select("x", "h", "a"), ["x", "h"]).filter("id <> a").select("a", F.col("id").alias("b"))
        self._writes.append(("keys", least.filter("new").select("x", "h", F.col("a").alias("id"))))
        # copies are linked by the key of their text, so one of them posts, and none if an earlier batch has posted the text
        one = checkpointed(sets.join(least.filter("new and text").select(F.col("a").alias("id")).distinct(), "id", "left_semi"))
        near = self._near(one, few)
        links = checkpointed(links.unionByName(near).distinct())
        self._writes.append(("sets", one))
        self._writes.append(("links", links))
        self._finish()
        return links.groupBy("b").agg(F.min("a").alias("a")).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))

    def _near(self, one: DataFrame, few: bool) -> DataFrame:
        """(a, b) links of a batch's new sets with each other and with history, whose postings they join."""
        each = one.select("id", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
        seen = each.groupBy("token").agg(F.count("*").alias("n"))
        old = checkpointed(self.found("postings", seen.select("token"), few))
        listed = seen.unionByName(old.filter("second = 0").groupBy(F.col("key").alias("token")).agg(F.count("*").alias("n")))
        hot = self.found("hot", seen.select("token"), few).withColumn("known", F.lit(True))
        # what is hot after this batch, and whether it was before
        hot = listed.groupBy("token").agg(F.sum("n").alias("n")).join(hot, "token", "left").filter((F.col("n") > HOT) | F.col("known"))
        hot = checkpointed(hot.select("token", F.col("known").isNull().alias("new")))

        def ranked(rows: DataFrame, hot: DataFrame) -> DataFrame:
            rows = rows.join(hot.select("token", F.lit(1).alias("n")), "token", "left").fillna(0, ["n"])
            return rows.groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("p"))

        def keys_of(ranked: DataFrame) -> DataFrame:
            return ranked.select("id", "size", F.explode(posting_keys(0)).alias("k")).select("k.key", "k.second", "id", "size")

        posted = checkpointed(keys_of(ranked(each, hot)))
        moved = checkpointed(old.filter("second = 0").join(hot.filter("new").select(F.col("token").alias("key")), "key", "left_semi").select("id").distinct())
        if not moved.isEmpty():
            # texts in the lists of tokens that have become hot: what they post beside what they have posted
            again = checkpointed(self.found("sets", moved, few).select("id", F.size("tokens").alias("size"), F.explode("tokens").alias("token")))
            now_hot = self.found("hot", again.select("token").distinct(), False).unionByName(hot.select("token")).distinct()
            more = keys_of(ranked(again, now_hot)).select("key", "second", "id", "size")
            known = self.found("postings", again.select("token").distinct(), False).select("key", "second", "id")
            more = checkpointed(more.join(known, ["key", "second", "id"], "left_anti"))
            self._writes.append(("postings", more))
            old = old.unionByName(more.select(*old.columns))
        a = old.withColumn("old", F.lit(True)).unionByName(posted.withColumn("old", F.lit(False)).select(*old.columns, "old")).alias("a")
        b = posted.alias("b")
        # ids mostly grow from batch to batch, but a late batch may hold smaller ones
        fits = (F.least("a.size", "b.size") >= THRESHOLD * F.greatest("a.size", "b.size")) & F.when(F.col("a.old"), F.col("a.id") != F.col("b.id")).otherwise(F.col("a.id") < F.col("b.id"))
        pairs = checkpointed(a.join(b, ["key", "second"]).filter(fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct())
        candidates = self.found("sets", pairs.select("a").distinct(), few).unionByName(one)
        links = checkpointed(verified(pairs, candidates, one))
        self._writes.append(("postings", posted))
        self._writes.append(("hot", hot.filter("new")))
        return links

    def groups(self) -> DataFrame:
        """(id_a, id_b) of all history: each notice that repeats one, with the earliest of its group."""
        return components(self.stored("links").select("a", "b")).filter("node <> root").select(F.col("root").alias("id_a"), F.col("node").alias("id_b"))


def repeats_in_batches(notices: DataFrame, hashes: DataFrame, first_run: DataFrame, path: str, batches: int = BATCHES) -> DataFrame:
    """(id_a, id_b) by taking the notices in batch by batch into an index at ``path``.

    first_run: (id, run), the run that brought each notice. The first run is the first batch, the
    others follow in ``batches - 1`` parts of equal numbers of runs; notices without a run come last.
    No batch sees anything of a later one: rows are prepared each by itself and laid down by batch.
    """
    spark = notices.sparkSession
    last = first_run.agg(F.max("run")).first()[0] or 1
    part = F.when(F.col("run") <= 1, 0).otherwise(1 + F.floor((F.coalesce("run", F.lit(last)) - 2) * (batches - 1) / max(1, last - 1))).cast("int")
    brought = first_run.groupBy("id").agg(F.min("run").alias("run")).select("id", F.least(F.coalesce(part, F.lit(batches - 1)), F.lit(batches - 1)).alias("batch"))
    rows = prepared(notices).join(brought, "id", "left").fillna(batches - 1, ["batch"])
    rows.repartition("batch", F.pmod("id", F.lit(8))).write.partitionBy("batch").parquet(f"{path}/arriving/notices")
    seen = hashes.filter("content_hash <> ''").select("notice_id", "content_hash").distinct().join(brought.withColumnRenamed("id", "notice_id"), "notice_id", "left").fillna(batches - 1, ["batch"])
    seen.repartition("batch").write.partitionBy("batch").parquet(f"{path}/arriving/hashes")
    index = HistoryIndex(spark, path)
    arriving = [spark.read.schema(",".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema)).parquet(f"{path}/arriving/{n}") for x, n in ((rows, "notices"), (seen, "hashes"))]
    for i in range(batches):
        index.add(*(x.filter(F.col("batch") == i).drop("batch") for x in arriving))
    return index.groups()
