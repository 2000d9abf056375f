"""A lexical index kept as a log: immutable segments with addressed postings, tombstones, merges.

A segment holds the chunks that one commit added. Its postings stand in blocks (term, slice): a term that more than BLOCK
chunks have is cut into 2^bits slices by the first bits of the chunk id's hash, so a block is bounded, a common term is
spread over all buckets, and where a (term, chunk) stands is known without looking. Postings are files by bucket (a hash
of term and slice), sorted by block; beside them a directory has each term's bits, frequencies and what bounds its
impact, and the same bounds for each block of a common term.

Replacing or deleting documents writes tombstones (segment, doc_id), never the segment. A merge rewrites small segments and
those mostly dead into one, from their postings. Every commit is one entry of a log that names the whole state, so a reader
keeps the snapshot that it began with, going back is an entry that repeats an earlier one, and a crash leaves the old state.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.errors import CommitConflict, GenerationUnavailable
from quillon.functions.text import phrases
from quillon.operators.lexical import B, FLOOR_IDF, K1, LexicalIndex, bm25, post
from quillon.runtime import forget, written
from quillon.sources.log import CommitLog, delete, names_in

#: Postings of a block, of a bucket of files, and below which a segment is one bucket; addresses written into a plan as literals, at most.
BLOCK, PER_BUCKET, ONE_BUCKET, LITERALS = 2048, 1 << 20, 1 << 14, 256
#: Buckets of a segment that is more than one.
LEAST_BUCKETS = 32
#: Segments below this many chunks are merged once so many of them have gathered.
SMALL, FANOUT = 100_000, 8
#: Commits that are tried before a writer gives up.
TRIES = 16


@dataclass(frozen=True)
class Segment:
    """A segment as a snapshot sees it: written once; chunks and tokens are those alive."""

    name: str
    buckets: int
    written: int
    chunks: int
    tokens: int


@dataclass(frozen=True)
class Snapshot:
    """Segments, and the tables of tombstones with the segments that each names."""

    number: int
    segments: tuple[Segment, ...] = ()
    dead: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def chunks(self) -> int:
        return sum(s.chunks for s in self.segments)

    @property
    def average(self) -> float:
        return sum(s.tokens for s in self.segments) / self.chunks if self.chunks else 0.0

    def entry(self) -> dict:
        return {"segments": [vars(s) for s in self.segments], "dead": [[n, list(s)] for n, s in self.dead]}


def _bucket(buckets: Column, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), buckets).cast("int")


def _slice(chunk: Column, bits: Column) -> Column:
    """The first ``bits`` bits of a chunk id's hash."""
    return F.when(bits > 0, F.expr(f"shiftrightunsigned(xxhash64({chunk}), CAST(64 - bits AS INT))")).otherwise(0).cast("int")


@dataclass
class IndexView:
    """A snapshot of an index, with the tables that :class:`~quillon.operators.lexical.LexicalIndex` has too."""

    index: SegmentIndex
    snap: Snapshot

    @property
    def postings(self) -> DataFrame:
        return self.index.postings(self.snap)

    @property
    def counts(self) -> DataFrame:
        """(term, chunk_id, tf) of every living posting."""
        return self.index.entries(self.index._read("postings", self.snap.segments), self.snap).select("term", "chunk_id", "tf")

    @property
    def terms(self) -> DataFrame:
        return self.index.terms(self.snap)

    @property
    def lengths(self) -> DataFrame:
        return self.index.lengths(self.snap)

    def search(self, queries: DataFrame, k: int = 30, docs: DataFrame | None = None) -> DataFrame:
        return self.index.search(queries, k, docs, self.snap)


class SegmentIndex:
    """The index of chunks (chunk_id, doc_id, text) under one folder. A chunk id is unique; a document is replaced as a whole."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/log")

    # -- snapshots

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The state of a commit, the last one by default; the empty one before the first."""
        if number is None:
            number, entry = self.log.last()
        else:
            entry = self.log.entry(number) if number else {}
            if entry is None:
                raise GenerationUnavailable(f"no commit {number} in {self.root}")
        return Snapshot(number, tuple(Segment(**s) for s in entry.get("segments", [])), tuple((n, tuple(s)) for n, s in entry.get("dead", [])))

    def view(self, number: int | None = None) -> IndexView:
        return IndexView(self, self.snapshot(number))

    def _commit(self, change, base: int | None = None) -> int:
        """Put ``change(snapshot)`` as the next entry; where another writer was first, from its state anew (with ``base`` given: from base)."""
        for _ in range(TRIES):
            last = self.log.last()[0]
            after = change(self.snapshot(base))
            try:
                return self.log.put(last + 1, after.entry())
            except CommitConflict:
                continue
        raise CommitConflict(f"{self.root}: {TRIES} commits were lost to other writers")

    # -- reading

    def _read(self, kind: str, segments: tuple[Segment, ...]) -> DataFrame:
        """Rows of all ``segments``, with the columns seg and bucket; one scan."""
        base = f"{self.root}/{kind}"
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/seg={s.name}" for s in segments]).withColumn("seg", F.col("seg").cast("string"))

    def _dead(self, snap: Snapshot) -> DataFrame | None:
        """(seg, doc_id) of the rows that count no more."""
        if not snap.dead:
            return None
        return self.spark.read.parquet(*[f"{self.root}/tombstones/{n}" for n, _ in snap.dead]).select("seg", "doc_id")

    def _alive(self, rows: DataFrame, snap: Snapshot) -> DataFrame:
        dead = self._dead(snap)
        return rows if dead is None else rows.join(dead, ["seg", "doc_id"], "left_anti")

    def _few(self, words: DataFrame) -> list[str] | None:
        """The asked words (term), distinct, where they are few enough to stand in a plan as literals; else None."""
        found = [r.term for r in words.select("term").distinct().limit(LITERALS + 1).collect()]
        return sorted(found) if len(found) <= LITERALS else None

    def directory(self, words: DataFrame, snap: Snapshot, few: list[str] | None = None) -> DataFrame:
        """(seg, term, bits, df, cf, max_tf, min_len, buckets) of the asked words (term), each segment's own numbers.

        ``few``: the same words as a list; folders and row groups are pruned by them, and what is found is a local table.
        """
        sizes = F.create_map(*[F.lit(x) for s in snap.segments for x in (s.name, s.buckets)])
        rows = self._read("terms", snap.segments)
        columns = ("seg", "term", "bits", "df", "cf", "max_tf", "min_len")
        if few is None:
            return rows.join(words.select("term").distinct(), "term", "left_semi").select(*columns).withColumn("buckets", sizes[F.col("seg")])
        at = self._literal(self.spark.createDataFrame([(w, s.buckets) for w in few for s in snap.segments], "term string, buckets int").select("term", _bucket(F.col("buckets"), "term").alias("bucket")))
        found = rows.where(at).select(*columns).withColumn("buckets", sizes[F.col("seg")])
        return self.spark.createDataFrame(found.collect(), found.schema)

    @staticmethod
    def _literal(keys: DataFrame) -> Column:
        """A filter on bucket and term from a local table: its rows are computed by the driver, without a job."""
        rows = keys.collect()
        return F.col("bucket").isin(sorted({r.bucket for r in rows})) & F.col("term").isin(sorted({r.term for r in rows})) if rows else F.lit(False)

    def _address(self, directory: DataFrame) -> Column:
        """The filter for all blocks of a local directory's words."""
        return self._literal(self.all_slices(directory).select("term", _bucket(F.col("buckets"), "term", "slice").alias("bucket")))

    @staticmethod
    def all_slices(directory: DataFrame) -> DataFrame:
        return directory.select("seg", "term", "buckets", F.explode(F.expr("sequence(0, CAST(pow(2, bits) AS INT) - 1)")).alias("slice"))

    def blocks(self, wanted: DataFrame, snap: Snapshot, address: Column | None = None) -> DataFrame:
        """The postings (seg, term, slice, chunk_id, doc_id, len, tf, positions) of the blocks ``wanted`` (seg, term, slice); ``address`` prunes folders and row groups."""
        rows = self._read("postings", snap.segments)
        rows = rows if address is None else rows.where(address)
        return rows.drop("bucket").join(wanted.select("seg", "term", "slice").distinct(), ["seg", "term", "slice"], "left_semi")

    def entries(self, blocks: DataFrame, snap: Snapshot, positions: bool = False) -> DataFrame:
        """Postings (seg, term, chunk_id, doc_id, len, tf) of blocks, those alive."""
        columns = ["seg", "term", "chunk_id", "doc_id", "len", "tf", *(["positions"] if positions else [])]
        return self._alive(blocks.select(*columns), snap)

    def lookup(self, asked: DataFrame, directory: DataFrame, snap: Snapshot, positions: bool = False, address: Column | None = None) -> DataFrame:
        """``asked`` (seg, chunk_id, term and more) with tf and positions where the chunk has the term: of the blocks only those that can hold one are opened."""
        placed = asked.join(directory.select("seg", "term", "bits"), ["seg", "term"]).withColumn("slice", _slice("chunk_id", F.col("bits")))
        found = self.entries(self.blocks(placed, snap, address), replace(snap, dead=()), positions).drop("doc_id", "len")
        return asked.join(found, ["seg", "term", "chunk_id"])

    def terms(self, snap: Snapshot | None = None) -> DataFrame:
        """(term, df, cf) of all terms over the living chunks."""
        snap = snap or self.snapshot()
        if not snap.segments:
            return self.spark.createDataFrame([], "term string, df long, cf long")
        hurt = {s for _, segs in snap.dead for s in segs}
        whole = tuple(s for s in snap.segments if s.name not in hurt)
        parts = [self._read("terms", whole).select("term", "df", "cf")] if whole else []
        if len(whole) < len(snap.segments):
            rest = self._read("postings", tuple(s for s in snap.segments if s.name in hurt))
            parts.append(self.entries(rest, snap).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
        out = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
        return out if len(snap.segments) == 1 else out.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def lengths(self, snap: Snapshot | None = None) -> DataFrame:
        """(chunk_id, doc_id, len) of every living chunk."""
        snap = snap or self.snapshot()
        if not snap.segments:
            return self.spark.createDataFrame([], "chunk_id string, doc_id string, len int")
        return self._alive(self._read("lengths", snap.segments), snap).select("chunk_id", "doc_id", "len")

    def postings(self, snap: Snapshot | None = None) -> DataFrame:
        """All living postings (seg, term, chunk_id, doc_id, len, tf, positions)."""
        snap = snap or self.snapshot()
        return self.entries(self._read("postings", snap.segments), snap, positions=True)

    # -- writing

    def _write(self, postings: DataFrame, lengths: DataFrame) -> Segment | None:
        """A new segment of postings (term, chunk_id, doc_id, len, tf, positions; a written table) and lengths (chunk_id, doc_id, len)."""
        name = f"s{uuid.uuid4().hex}"
        n = postings.count()
        buckets = 1 if n <= ONE_BUCKET else max(LEAST_BUCKETS, 1 << max(0, (n // PER_BUCKET).bit_length()))
        at = lambda kind: f"{self.root}/{kind}/seg={name}"
        # every chunk's own length, chunks without a word too
        lengths.withColumn("bucket", _bucket(F.lit(buckets), "doc_id")).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(at("lengths"))
        live = self.spark.read.parquet(at("lengths")).agg(F.count(F.lit(1)), F.sum("len")).first() if names_in(self.spark, at("lengths")) != ["_SUCCESS"] else (0, 0)
        if not live[0]:
            return None
        terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
        bits = F.when(F.col("df") > BLOCK, F.ceil(F.log2(F.col("df") / BLOCK))).otherwise(0).cast("int")
        terms = terms.withColumn("bits", bits).withColumn("bucket", _bucket(F.lit(buckets), "term"))
        packed = lambda df, *by: df.sortWithinPartitions("bucket", *by).write.partitionBy("bucket").option("parquet.block.size", 8 << 20).option("compression", "zstd")
        packed(terms.repartition(buckets, "bucket"), "term").parquet(at("terms"))
        if not n:  # a table without rows has no file that names its columns
            terms.drop("bucket").write.parquet(f"{at('terms')}/bucket=0")
        # a row for every BLOCK postings at most; not broadcast, all postings would be shuffled and sorted by term once more
        common = F.broadcast(self.spark.read.parquet(at("terms")).where("bits > 0").select("term", "bits"))
        placed = postings.join(common, "term", "left").withColumn("slice", _slice("chunk_id", F.col("bits")))
        bucket = _bucket(F.lit(buckets), "term", "slice")
        # what follows from the rest of a row isn't shuffled with it
        dealt = placed.select("term", "chunk_id", "doc_id", "len", "positions", "slice").repartition(buckets, bucket)
        placed = dealt.select("term", "chunk_id", "doc_id", "len", F.size("positions").alias("tf"), "positions", "slice", bucket.alias("bucket"))
        packed(placed, "term", "slice", "chunk_id").parquet(at("postings"))
        if not n:
            placed.drop("bucket").write.parquet(f"{at('postings')}/bucket=0")
        blocks = self.spark.read.parquet(at("postings")).join(common, "term").groupBy("term", "slice").agg(F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
        blocks.coalesce(1 if buckets == 1 else buckets).sortWithinPartitions("term").write.parquet(at("bounds"))
        return Segment(name, buckets, live[0], live[0], live[1])

    def _hits(self, docs: DataFrame, snap: Snapshot) -> DataFrame:
        """(seg, doc_id, chunks, tokens) that are alive of documents: only the buckets of lengths that can have them are read."""
        asked = written(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), "asked-documents")
        parts = None
        for size in sorted({s.buckets for s in snap.segments}):
            segs = tuple(s for s in snap.segments if s.buckets == size)
            rows = self._read("lengths", segs)
            few = asked.select(_bucket(F.lit(size), "doc_id").alias("bucket")).distinct().limit(LITERALS + 1).collect()
            if len(few) <= LITERALS:
                rows = rows.where(F.col("bucket").isin(sorted(r.bucket for r in few))) if few else rows.limit(0)
            found = self._alive(rows.join(asked, "doc_id", "left_semi"), snap).groupBy("seg", "doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("tokens"))
            parts = found if parts is None else parts.unionByName(found)
        return parts

    def _bury(self, docs: DataFrame, snap: Snapshot) -> Snapshot:
        """The snapshot without documents: tombstones for those that it has."""
        if not snap.segments:
            return snap
        name = uuid.uuid4().hex
        self._hits(docs, snap).write.parquet(f"{self.root}/tombstones/{name}")
        lost = {r.seg: (r.chunks, r.tokens) for r in self.spark.read.parquet(f"{self.root}/tombstones/{name}").groupBy("seg").agg(F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens")).collect()}  # a row per segment
        if not lost:
            return snap
        less = tuple(replace(s, chunks=s.chunks - lost.get(s.name, (0, 0))[0], tokens=s.tokens - lost.get(s.name, (0, 0))[1]) for s in snap.segments)
        return self._without_empty(replace(snap, segments=less, dead=(*snap.dead, (name, tuple(sorted(lost))))))

    @staticmethod
    def _without_empty(snap: Snapshot) -> Snapshot:
        kept = tuple(s for s in snap.segments if s.chunks)
        names = {s.name for s in kept}
        return replace(snap, segments=kept, dead=tuple((n, s) for n, s in snap.dead if names & {*s}))

    def add(self, chunks: DataFrame, base: int | None = None) -> int:
        """Add chunks as a segment; documents that the index has already are replaced. Returns the commit's number.

        Texts are read and tokenized once. Work follows the new chunks: of older segments only the length buckets that can
        have one of their documents are read. Null texts are chunks without a word.
        """
        own = chunks.select("chunk_id", "doc_id", "text")
        postings = written(post(own), "new-postings")
        sizes = postings.select("chunk_id", "len").dropDuplicates(["chunk_id"])
        lengths = written(own.select("chunk_id", "doc_id").join(sizes, "chunk_id", "left").select("chunk_id", "doc_id", F.coalesce("len", F.lit(0)).alias("len")), "new-lengths")
        segment = self._write(postings, lengths)

        def change(snap: Snapshot) -> Snapshot:
            after = self._bury(lengths, snap)
            return after if segment is None else replace(after, segments=(*after.segments, segment))

        forget(postings)
        number = self._commit(change, base)
        forget(lengths)
        return number

    def remove(self, docs: DataFrame, base: int | None = None) -> int:
        """Delete documents (doc_id); the files of others aren't touched."""
        return self._commit(lambda snap: self._bury(docs, snap), base)

    def roll_back(self, number: int) -> int:
        """A commit that repeats the state of an earlier one."""
        return self._commit(lambda snap: self.snapshot(number))

    def merge(self, small: int = SMALL, fanout: int = FANOUT, base: int | None = None) -> int | None:
        """Rewrite small segments, if there are ``fanout`` of them, and those of which more than half is dead, as one; None: nothing to do."""

        def due(snap: Snapshot) -> tuple[Segment, ...]:
            low = [s for s in snap.segments if s.chunks <= small]
            half = [s for s in snap.segments if 2 * s.chunks < s.written]
            return tuple(s for s in snap.segments if (s in low and len(low) >= fanout) or s in half)

        if not due(self.snapshot(base)):
            return None

        def change(snap: Snapshot) -> Snapshot:
            old = due(snap)
            own = replace(snap, segments=old)
            postings = written(self.postings(own).drop("seg"), "merged-postings")
            lengths = written(self.lengths(own), "merged-lengths")
            segment = self._write(postings, lengths)
            forget(postings)
            forget(lengths)
            kept = tuple(s for s in snap.segments if s not in old)
            return self._without_empty(replace(snap, segments=kept if segment is None else (*kept, segment)))

        return self._commit(change, base)

    def vacuum(self, keep: int = 10, named: tuple[int, ...] = ()) -> list[str]:
        """Delete segments and tombstones that none of the last ``keep`` commits nor ``named`` ones name, and the other entries; returns what went.

        Not beside a writer: what is written and not yet committed counts as unnamed.
        """
        numbers = self.log.numbers()
        kept = {*(numbers[-keep:] if keep else []), *named}
        states = [self.snapshot(n) for n in numbers if n in kept and self.log.entry(n) is not None]
        segments = {s.name for x in states for s in x.segments}
        dead = {n for x in states for n, _ in x.dead}
        gone = []
        for kind in ("postings", "bounds", "terms", "lengths"):
            gone += [f"{kind}/{n}" for n in names_in(self.spark, f"{self.root}/{kind}") if n.startswith("seg=") and n[4:] not in segments]
        gone += [f"tombstones/{n}" for n in names_in(self.spark, f"{self.root}/tombstones") if n not in dead]
        gone += [f"log/{n:012d}.json" for n in numbers if n not in kept]
        for name in gone:
            delete(self.spark, f"{self.root}/{name}")
        return gone

    # -- searching

    def search(self, queries: DataFrame, k: int = 30, docs: DataFrame | None = None, snap: Snapshot | None = None, qid: str = "qid", text_col: str = "text") -> DataFrame:
        """(qid, chunk_id, doc_id, bm25_score, bm25_rank): the k best chunks that have every phrase of the query.

        As :func:`quillon.operators.lexical.bm25` over an index that was built anew from the living chunks: phrase
        weights come from all of them, also under a document filter ``docs`` (doc_id); equal scores go by chunk_id.

        Only asked terms are read, up to LITERALS of them (a larger batch goes once through all postings). The rarest phrase of a query gives its candidates, the others are looked up in the
        blocks that can hold a candidate. Where one word is the whole query, its blocks come in the order of the score
        that they can reach at most, and those that can't reach the k-th best aren't read.
        """
        snap = snap or self.snapshot()
        parsed = queries.select(F.col(qid).alias("qid"), phrases(F.col(text_col)).alias("p"))
        parts = parsed.select("qid", F.explode("p").alias("words")).withColumn("phrase", F.array_join("words", " "))
        asks = written(parts.groupBy("qid", "phrase").agg(F.count(F.lit(1)).cast("int").alias("times"), F.first("words").alias("words")), "asks")
        few = self._few(asks.select(F.explode("words").alias("term"))) if snap.segments else []
        if few == []:
            none = self.lengths(snap).limit(0).select("chunk_id", "doc_id", F.lit(0.0).alias("bm25_score"), F.lit(1).alias("bm25_rank"))
            return asks.limit(0).select("qid").join(none, F.lit(False)).select("qid", *none.columns)
        if few is None:  # a batch that asks for so many words reads most of the index: once through is the better plan
            stats = self.spark.range(1).select(F.lit(snap.chunks).alias("n"), F.lit(snap.average).alias("avg_len"))
            return bm25(LexicalIndex(self.postings(snap).drop("seg"), self.terms(snap), self.lengths(snap), stats), queries, k, docs, qid, text_col)
        directory = self.directory(asks.select(F.explode("words").alias("term")), snap, few)
        address = self._address(directory)
        df = self._frequencies(directory, snap, address)
        listed = None
        if not asks.where(F.size("words") > 1).isEmpty():
            long = asks.where(F.size("words") > 1).select("phrase", "words").dropDuplicates(["phrase"])
            listed = written(self._phrases(long, directory, df, snap, address), "phrases")
            df = df.unionByName(listed.groupBy(F.col("phrase").alias("term")).agg(F.count(F.lit(1)).alias("df")))
        every = Window.partitionBy("qid")
        known = asks.join(df.withColumnRenamed("term", "phrase"), "phrase", "left").withColumn("n_terms", F.count(F.lit(1)).over(every)).withColumn("have", F.count("df").over(every))
        known = known.where("have = n_terms").withColumn("place", F.row_number().over(every.orderBy("df", "phrase")))
        raw = F.log((F.lit(snap.chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("times") * F.when(raw > 0, raw).otherwise(FLOOR_IDF)
        known = written(known.select("qid", "phrase", (F.size("words") > 1).alias("long"), weight.alias("weight"), "n_terms", "place"), "weighed")
        impact = lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(snap.average)))
        only = docs.select("doc_id").distinct() if docs is not None else None

        first = known.where("place = 1")
        asked = first.where("NOT long AND n_terms > 1").select("qid", F.col("phrase").alias("term"), "weight", "n_terms")
        lists = self.entries(self.blocks(self.all_slices(directory.join(asked.select("term").distinct(), "term", "left_semi")), snap, address), snap)
        lead = lists.join(asked, "term").select("qid", "seg", "chunk_id", "doc_id", "len", "tf", "weight", "n_terms")
        if listed is not None:
            lead = lead.unionByName(listed.join(first.where("long").select("qid", "phrase", "weight", "n_terms"), "phrase").select(*lead.columns))
        if only is not None:
            lead = lead.join(only, "doc_id", "left_semi")
        lead = written(lead.select("qid", "seg", "chunk_id", "doc_id", "len", "n_terms", (F.col("weight") * impact(F.col("tf"), F.col("len"))).alias("part")), "candidates")
        rest = known.where("place > 1")
        pairs = lead.select("qid", "seg", "chunk_id", "len").join(rest.where("NOT long").select("qid", F.col("phrase").alias("term"), "weight"), "qid")
        part = (F.col("weight") * impact(F.col("tf"), F.col("len"))).alias("part")
        others = self.lookup(pairs, directory, snap, address=address).select("qid", "chunk_id", part)
        if listed is not None:
            named = lead.select("qid", "chunk_id").join(rest.where("long").select("qid", "phrase", "weight"), "qid").join(listed, ["phrase", "chunk_id"])
            others = others.unionByName(named.select("qid", "chunk_id", part))
        sums = others.groupBy("qid", "chunk_id").agg(F.sum("part").alias("more"), F.count(F.lit(1)).alias("have"))
        total = lead.join(sums, ["qid", "chunk_id"], "left").where(F.coalesce("have", F.lit(0)) + 1 == F.col("n_terms"))
        total = total.select("qid", "chunk_id", "doc_id", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("bm25_score"))
        single = first.where("n_terms = 1 AND NOT long")
        if not single.isEmpty():
            total = total.unionByName(self._single(single, directory, snap, k, only, impact, address))
        order = Window.partitionBy("qid").orderBy(F.round("bm25_score", 9).desc(), "chunk_id")
        out = total.withColumn("bm25_rank", F.row_number().over(order))
        return out.where(F.col("bm25_rank") <= k).select("qid", "chunk_id", "doc_id", "bm25_score", "bm25_rank")

    def _frequencies(self, directory: DataFrame, snap: Snapshot, address: Column | None) -> DataFrame:
        """(term, df) over the living chunks: the directory's numbers, counted anew in segments that have lost documents."""
        hurt = sorted({s for _, segs in snap.dead for s in segs})
        whole = directory.where(~F.col("seg").isin(hurt)) if hurt else directory
        out = whole.select("term", "df")
        if hurt:
            lists = self.blocks(self.all_slices(directory.where(F.col("seg").isin(hurt))), snap, address)
            out = out.unionByName(self.entries(lists, snap).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        out = out.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return written(out, "frequencies") if hurt else out

    def _single(self, asked: DataFrame, directory: DataFrame, snap: Snapshot, k: int, only: DataFrame | None, impact, address: Column | None) -> DataFrame:
        """(qid, chunk_id, doc_id, bm25_score) of queries of one word: the blocks that can hold one of its k best chunks.

        A block's greatest term count and least length bound its scores. The k blocks with the highest bounds are read
        first; the k-th score in these is a floor, and further blocks under it are left where they are. Under a document
        filter a bound says nothing about what passes it, so all are read.
        """
        slices = self.all_slices(directory.join(asked.select(F.col("phrase").alias("term")).distinct(), "term", "left_semi"))
        scores = lambda lists: lists.select("term", "seg", "chunk_id", "doc_id", impact(F.col("tf"), F.col("len")).alias("s"))
        if only is not None:
            found = scores(self.entries(self.blocks(slices, snap, address), snap).join(only, "doc_id", "left_semi"))
        else:
            bound = self._bounds(slices, directory, snap).select("seg", "term", "slice", impact(F.col("max_tf"), F.col("min_len")).alias("bound"))
            down = Window.partitionBy("term").orderBy(F.col("bound").desc(), "seg", "slice")
            bound = written(bound.withColumn("before", F.row_number().over(down) - 1), "block-bounds")
            found = scores(self.entries(self.blocks(bound.where(F.col("before") < k), snap, address), snap))
            if not bound.where(F.col("before") >= k).isEmpty():
                start = written(found, "first-blocks")
                top = Window.partitionBy("term").orderBy(F.col("s").desc(), "chunk_id")
                floor = start.withColumn("r", F.row_number().over(top)).where(F.col("r") == k).select("term", F.col("s").alias("floor"))
                # scores are ranked to 9 places after their weight, so what is equal then may differ by so much before it
                least = asked.groupBy(F.col("phrase").alias("term")).agg((1e-9 / F.min("weight") + 1e-9).alias("room"))
                more = bound.where(F.col("before") >= k).join(floor, "term", "left").join(least, "term").where("floor IS NULL OR bound >= floor - room")
                found = start.unionByName(scores(self.entries(self.blocks(more, snap, address), snap)))
        scored = found.join(asked.select("qid", F.col("phrase").alias("term"), "weight"), "term")
        return scored.select("qid", "chunk_id", "doc_id", (F.col("weight") * F.col("s")).alias("bm25_score"))

    def _bounds(self, slices: DataFrame, directory: DataFrame, snap: Snapshot) -> DataFrame:
        """(seg, term, slice, max_tf, min_len) of blocks: a common term's are written with its segment, of others the directory has the one."""
        one = slices.join(directory.where("bits = 0").select("seg", "term", "max_tf", "min_len"), ["seg", "term"])
        several = slices.join(self._read("bounds", snap.segments), ["seg", "term", "slice"])
        return one.select("seg", "term", "slice", "max_tf", "min_len").unionByName(several.select("seg", "term", "slice", "max_tf", "min_len"))

    def _phrases(self, asked: DataFrame, directory: DataFrame, df: DataFrame, snap: Snapshot, address: Column | None) -> DataFrame:
        """(phrase, seg, chunk_id, doc_id, len, tf) of phrases (phrase, words): its words stand one after the other, tf times."""
        words = asked.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("j", "term"))
        every = Window.partitionBy("phrase")
        known = words.join(df, "term").withColumn("have", F.count(F.lit(1)).over(every)).where("have = n")
        known = written(known.withColumn("place", F.row_number().over(every.orderBy("df", "j"))).select("phrase", "n", "j", "term", "place"), "phrase-words")
        lead = known.where("place = 1")
        lists = self.blocks(self.all_slices(directory.join(lead.select("term").distinct(), "term", "left_semi")), snap, address)
        shifted = F.transform("positions", lambda p: p - F.col("j")).alias("starts")
        found = self.entries(lists, snap, positions=True).join(lead.select("phrase", "n", "j", "term"), "term")
        found = written(found.select("phrase", "n", "seg", "chunk_id", "doc_id", "len", shifted), "phrase-leads")
        asked_rest = found.select("phrase", "seg", "chunk_id").join(known.where("place > 1").select("phrase", "j", "term"), "phrase")
        rest = self.lookup(asked_rest, directory, snap, True, address).select("phrase", "seg", "chunk_id", shifted)
        rest = rest.groupBy("phrase", "seg", "chunk_id").agg(F.collect_list("starts").alias("lists"))
        whole = found.join(rest, ["phrase", "seg", "chunk_id"]).where(F.size("lists") == F.col("n") - 1)
        tf = F.size(F.aggregate("lists", F.col("starts"), lambda a, b: F.array_intersect(a, b)))
        return whole.select("phrase", "seg", "chunk_id", "doc_id", "len", tf.alias("tf")).where("tf > 0")
