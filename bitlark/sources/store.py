"""Versioned indexes on Parquet.

``<root>/ns=<n>/manifest-<version>.json`` names immutable segments. A commit writes new segments and then
publishes the next manifest whole and exclusively, so a commit is atomic, two writers can't both win, and a reader
that holds a version reads the same files for ever. The newest record of a document or tag wins: reading is
the base segments minus the ids of later ones plus their newest records. A commit that would leave more than ``MERGE_AT`` later segments
merges those (not the base) into one; ``fold`` merges all into one base.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AlreadyExists, CompactionMismatch, CompactionPending, CorruptMeta, InvalidArgument, KeyspaceOccupied, SnapshotExpired, UnsupportedLayout, WriterStopped
from ..functions import codes, residual
from ..operators import compaction, filters, search
from .files import Files

LAYOUT = 1
#: More segments than this after the base are merged by the commit that makes them.
MERGE_AT = 8
STATS = "block int, w_min int, w_max int, n bigint"
POSTINGS = "dim int, doc_id bigint, weight int"
MUTATIONS = "seq long, op string, doc_id long, words array<long>, positions array<int>, embedding array<float>, terms array<int>"
OPS = ("put", "delete", "attr", "unattr")


@dataclass(frozen=True)
class Manifest:
    version: int
    dims: int
    model_id: str | None = None
    docs: tuple[str, ...] = ()  # oldest first
    attrs: tuple[str, ...] = ()
    stats: str | None = None
    postings: str | None = None
    pending: dict | None = None
    batches: dict = field(default_factory=dict)
    next_seq: int = 0

    def to_json(self) -> bytes:
        return json.dumps({"layout": LAYOUT, "kind": "bitlark-index"} | self.__dict__).encode()

    @classmethod
    def from_json(cls, data: bytes) -> Manifest:
        try:
            got = json.loads(data)
            if got.pop("kind") != "bitlark-index":
                raise CorruptMeta("not a manifest")
            layout = got.pop("layout")
            if layout != LAYOUT:
                raise UnsupportedLayout(f"layout {layout}")
            return cls(**got | {"docs": tuple(got["docs"]), "attrs": tuple(got["attrs"])})
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptMeta(str(e)) from e


def resolve_namespace(spark: SparkSession, root: str, namespace: int | None) -> int:
    """The stated namespace, else 1, unless only 0 holds an index."""
    if namespace is not None:
        if not 0 <= namespace <= 255:
            raise InvalidArgument("a namespace is one byte")
        return namespace
    files = Files(spark)
    if not files.names(f"{root}/ns=1") and files.names(f"{root}/ns=0"):
        raise InvalidArgument("namespace 0 holds an index; name 0 to open it or 1 to make another")
    return 1


class Index:
    def __init__(self, spark: SparkSession, path: str, manifest: Manifest) -> None:
        self.spark, self.path, self.manifest = spark, path, manifest
        self.stopped = False

    # -- life ------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, dims: int, namespace: int | None = None, model: residual.Model | None = None) -> Index:
        codes.check_dims(dims)
        if model is not None:
            model.require(dims, model.model_id)
        path = f"{root}/ns={resolve_namespace(spark, root, namespace)}"
        files = Files(spark)
        there = files.names(path)
        if any(n.startswith("manifest-") for n in there):
            raise AlreadyExists(path)
        if there:
            raise KeyspaceOccupied(f"{path} holds other files")
        made = Manifest(0, dims, model.model_id.hex() if model else None)
        files.create(f"{path}/{_name(0)}", made.to_json())
        return cls(spark, path, made)

    @classmethod
    def open(cls, spark: SparkSession, root: str, namespace: int | None = None, version: int | None = None, pending: bool = False) -> Index:
        path = f"{root}/ns={resolve_namespace(spark, root, namespace)}"
        files = Files(spark)
        versions = sorted(int(n[9:-5]) for n in files.names(path) if n.startswith("manifest-") and n.endswith(".json"))
        if not versions:
            raise InvalidArgument(f"no index at {path}")
        if version is not None and version not in versions:
            raise SnapshotExpired(f"version {version} is gone")
        got = Manifest.from_json(files.read(f"{path}/{_name(versions[-1] if version is None else version)}"))
        if got.pending and not pending:
            raise CompactionPending("recover the id map with compact(), then acknowledge()")
        return cls(spark, path, got)

    def at(self, version: int) -> Index:
        """The same index pinned at another version."""
        data = Files(self.spark)
        where = f"{self.path}/{_name(version)}"
        if not data.exists(where):
            raise SnapshotExpired(f"version {version} is gone")
        return Index(self.spark, self.path, Manifest.from_json(data.read(where)))

    def _publish(self, nxt: Manifest) -> int:
        if self.stopped:
            raise WriterStopped("an earlier publish had an unknown outcome; open the index again")
        try:
            Files(self.spark).create(f"{self.path}/{_name(nxt.version)}", nxt.to_json())
        except AlreadyExists as e:
            self.stopped = True
            raise WriterStopped(f"version {nxt.version} was published by another writer") from e
        except Exception:
            self.stopped = True
            raise
        self.manifest = nxt
        return nxt.version

    def _segment(self, kind: str, df: DataFrame) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    # -- reading ---------------------------------------------------------------

    @property
    def residual(self) -> bool:
        return self.manifest.model_id is not None

    def _code_fields(self) -> list[str]:
        if self.residual:
            return ["code binary"]
        n = codes.words_for(self.manifest.dims)
        return ["words array<bigint>"] if n > codes.MAX_COLUMNS else [f"w{i} bigint" for i in range(n)]

    def _docs_schema(self) -> str:
        return ", ".join(["doc_id bigint", "block int", *self._code_fields(), *([] if self.residual else ["weight int"]), "live boolean"])

    def _resolved(self, names: tuple[str, ...], schema: str, keys: list[str]) -> DataFrame:
        """Newest record of each key: the first segment is the base, later ones are small."""
        if not names:
            return self.spark.createDataFrame([], schema)
        read = lambda n: self.spark.read.schema(schema).parquet(f"{self.path}/{n}")
        base = read(names[0])
        if len(names) == 1:
            return base
        newest = self._newest(names[1:], schema, keys)
        return base.join(newest.select(*keys), keys, "left_anti").select(*base.columns).union(newest)

    def _newest(self, names: tuple[str, ...], schema: str, keys: list[str]) -> DataFrame:
        """Newest record of each key of some segments, deletions included."""
        later = None
        for i, n in enumerate(names):
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{n}").withColumn("_v", F.lit(i))
            later = part if later is None else later.union(part)
        columns = [c for c in later.columns if c != "_v"]
        rest = [c for c in columns if c not in keys]
        return later.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select(*keys, "_r.*").select(*columns)

    def _merged(self, kind: str, names: tuple[str, ...], schema: str, keys: list[str]) -> tuple[str, ...]:
        if len(names) <= MERGE_AT + 1:
            return names
        return names[0], self._segment(kind, self._newest(names[1:], schema, keys).sortWithinPartitions(*keys))

    def docs(self) -> DataFrame:
        """Live documents."""
        return self._resolved(self.manifest.docs, self._docs_schema(), ["doc_id"]).where("live").drop("live")

    def all_attrs(self) -> DataFrame:
        """(doc_id, term) as set, of live and retired documents alike."""
        return self._resolved(self.manifest.attrs, "doc_id bigint, term int, live boolean", ["doc_id", "term"]).where("live").drop("live")

    def stats(self) -> DataFrame:
        if not self.manifest.stats:
            return self.spark.createDataFrame([], STATS)
        return self.spark.read.schema(STATS).parquet(f"{self.path}/{self.manifest.stats}")

    def postings(self) -> DataFrame | None:
        """(dim, doc_id, weight) of every set bit, in files by dim; None where there are none for this version."""
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/{self.manifest.postings}") if self.manifest.postings else None

    def terms(self, lo: int = 0, hi: int = codes.MAX_TERM + 1) -> DataFrame:
        """(term, n): terms in [lo, hi) that are set on any document, and on how many."""
        return self.all_attrs().where((F.col("term") >= lo) & (F.col("term") < hi)).groupBy("term").agg(F.count("*").alias("n"))

    def lookup(self, *ids: int) -> DataFrame:
        """The live documents among these ids; the ids reach the scan."""
        return self.docs().where(F.col("doc_id").isin(list(ids)))

    def contains(self, doc_id: int) -> bool:
        return bool(self.lookup(doc_id).limit(1).count())

    def max_doc_id(self) -> DataFrame:
        """One row, max_doc_id: the greatest live id (null: none)."""
        return self.docs().agg(F.max("doc_id").alias("max_doc_id"))

    def corpus(self) -> search.Corpus:
        """The pinned version as a searchable corpus."""
        stats = self.stats() if self.manifest.stats else None
        return search.Corpus(self.docs(), self.all_attrs(), self.manifest.dims, stats, self.residual, self.manifest.version, self.postings())

    def search(self, code=(), **options) -> search.Search:
        return self.corpus().search(code, **options)

    def search_vector(self, query: residual.PreparedQuery, k: int = 10, f: filters.Filter | None = None) -> DataFrame:
        """(rank, doc_id, score): exact integer top-k of a residual index."""
        stored = self.manifest.model_id
        if stored is None:
            raise residual.NoModelIdentity("the index names no model")
        if bytes.fromhex(stored) != query.model_id:
            raise residual.ModelMismatch("the query was prepared by another model")
        rows = self.corpus().admitted(f or filters.All())
        return search.row_search(rows, residual.score_column(self.spark, query, F.col("code")), k)

    def count(self, f: filters.Filter | None = None) -> int:
        return self.corpus().count(f).first().n

    def describe(self) -> dict:
        r = self.docs().agg(F.count("*").alias("live"), F.count_distinct("block").alias("blocks"), F.max("doc_id").alias("top")).first()
        return {"live": r.live, "blocks": r.blocks, "max_doc_id": r.top, "blocks_with_stats": self.stats().count(), "dims": self.manifest.dims, "kind": "residual" if self.residual else "binary", "version": self.manifest.version}

    # -- writing ---------------------------------------------------------------

    def apply(self, mutations: DataFrame, model: residual.Model | None = None, batch: tuple[str, int] | None = None) -> dict:
        """Applies mutations (any of the ``MUTATIONS`` columns; seq orders them) as one commit.

        Returns version, written and deleted (requests, counted even where an id was absent). A batch (writer
        name, number) that was committed before is skipped.
        """
        if self.manifest.pending:
            raise CompactionPending("acknowledge the compaction before anything is written")
        done = self.manifest.batches
        if batch and done.get(batch[0], -1) >= batch[1]:
            return {"version": self.manifest.version, "written": 0, "deleted": 0, "skipped": True}
        for f in MUTATIONS.split(", "):
            name, kind = f.split(" ", 1)
            if name not in mutations.columns:
                mutations = mutations.withColumn(name, F.lit(None).cast(kind))
        counts = self._validate(mutations)
        last = mutations.where("op IN ('put', 'delete')").groupBy("doc_id").agg(F.max_by(F.struct("op", "words", "positions", "embedding"), "seq").alias("r")).select("doc_id", "r.*")
        puts = self._encoded(last.where("op = 'put'"), model).withColumn("live", F.lit(True))
        # a tombstone needs no more than the id, so the corpus isn't read
        kinds = dict(puts.dtypes)
        known = {"doc_id": F.col("doc_id"), "block": codes.block_of(F.col("doc_id")), "live": F.lit(False)}
        gone = last.where("op = 'delete'").select(*[known.get(c, F.lit(None).cast(kinds[c])).alias(c) for c in puts.columns])
        tags = mutations.where("op <> 'delete' AND terms IS NOT NULL").select("seq", "doc_id", F.explode("terms").alias("term"), (F.col("op") != "unattr").alias("live"))
        # within one seq the last listed operation wins; ids repeat only by caller error
        tags = tags.groupBy("doc_id", "term").agg(F.max_by("live", "seq").alias("live"))
        docs, attrs = self.manifest.docs, self.manifest.attrs
        stats = self.manifest.stats
        if counts.puts or counts.deletes:
            docs += (self._segment("docs", puts.union(gone).sortWithinPartitions("doc_id")),)
            if stats:
                made = self.spark.read.schema(self._docs_schema()).parquet(f"{self.path}/{docs[-1]}")
                touched = made.where("live").select("block")
                if counts.deletes:  # only ids that were there touch their blocks
                    touched = touched.union(self.docs().select("doc_id", "block").join(made.where("NOT live").select("doc_id"), "doc_id", "left_semi").select("block"))
                touched = touched.distinct()
                stats = self._segment("stats", self.stats().join(touched, "block", "left_anti"))
            docs = self._merged("docs", docs, self._docs_schema(), ["doc_id"])
        if counts.tagged:
            attrs += (self._segment("attrs", tags.select("doc_id", F.col("term").cast("int").alias("term"), "live").sortWithinPartitions("term", "doc_id")),)
            attrs = self._merged("attrs", attrs, "doc_id bigint, term int, live boolean", ["doc_id", "term"])
        postings = self.manifest.postings if docs == self.manifest.docs else None
        nxt = replace(self.manifest, version=self.manifest.version + 1, docs=docs, attrs=attrs, stats=stats, postings=postings, batches=done | ({batch[0]: batch[1]} if batch else {}))
        return {"version": self._publish(nxt), "written": counts.puts, "deleted": counts.deletes, "skipped": False}

    def _validate(self, m: DataFrame):
        """Refuses the whole batch by one aggregate over it."""
        last = codes.row_bits(self.manifest.dims)
        terms = F.coalesce(F.col("terms"), F.array().cast("array<int>"))
        p = F.col("positions")
        ascending = F.forall(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.get(p, i) > F.get(p, i - 1))
        bad_sparse = p.isNotNull() & (F.size(p) > 0) & ((F.get(p, F.lit(0)) < 0) | ((F.size(p) > 1) & ~ascending))
        put = F.col("op") == "put"
        r = m.agg(
            F.count_if(~F.col("op").isin(*OPS) | F.col("op").isNull() | F.col("seq").isNull() | F.col("doc_id").isNull()).alias("bad"),
            F.min(F.when(put, F.col("doc_id"))).alias("lo"),
            F.max(F.when(put, F.col("doc_id"))).alias("hi"),
            F.min(F.array_min(terms)).alias("tlo"),
            F.max(F.array_max(terms)).alias("thi"),
            F.max(F.when(put, F.size(F.coalesce("words", F.array().cast("array<long>"))))).alias("width"),
            F.max(F.when(put & p.isNotNull() & (F.size(p) > 0), F.array_max(p))).alias("top"),
            F.count_if(bad_sparse).alias("sparse"),
            F.count_if(put & (F.col("words").isNotNull().cast("int") + p.isNotNull().cast("int") + F.col("embedding").isNotNull().cast("int") != 1)).alias("forms"),
            F.count_if(put).alias("puts"),
            F.count_if(F.col("op") == "delete").alias("deletes"),
            F.count_if((F.col("op") != "delete") & (F.size(terms) > 0)).alias("tagged"),
        ).first()
        if r.bad or r.forms:
            raise InvalidArgument("a mutation lacks seq, doc_id, a known op or exactly one form of its code")
        for i in (r.lo, r.hi):
            if i is not None:
                codes.check_doc_id(i)
        for t in (r.tlo, r.thi):
            if t is not None:
                codes.check_term(t)
        if r.sparse:
            raise InvalidArgument("positions of a sparse code have to grow from one to the next")
        if (r.width or 0) > last // 64 or (r.top is not None and r.top >= last):
            raise codes.DimensionMismatch(self.manifest.dims, max(64 * (r.width or 0), (r.top or 0) + 1))
        return r

    def _encoded(self, puts: DataFrame, model: residual.Model | None) -> DataFrame:
        if self.residual:
            if model is None:
                raise InvalidArgument("a residual index takes embeddings and its model")
            model.require(self.manifest.dims, bytes.fromhex(self.manifest.model_id))
            code = residual.encode_column(self.spark, model, F.col("embedding"))
            return puts.select("doc_id", codes.block_of(F.col("doc_id")).alias("block"), code.alias("code"))
        dims = self.manifest.dims
        sparse = F.array(*codes.position_words(F.col("positions"), dims)) if codes.words_for(dims) <= codes.MAX_COLUMNS else _sparse_words(dims)
        return codes.stored(puts.select("doc_id", F.when(F.col("positions").isNotNull(), sparse).otherwise(F.col("words")).alias("words")), dims)

    def refresh_stats(self) -> int:
        """Weight range and number of documents of each block. Residual codes have no such bound: nothing is written, the version stays."""
        if self.residual:
            return self.manifest.version
        table = self.docs().groupBy("block").agg(F.min("weight").alias("w_min"), F.max("weight").alias("w_max"), F.count("*").alias("n"))
        return self._publish(replace(self.manifest, version=self.manifest.version + 1, stats=self._segment("stats", table)))

    def refresh_postings(self) -> int:
        """Stored postings for the inverted path; the next change of documents drops them."""
        if self.residual:
            return self.manifest.version
        docs = self.docs()
        rows = docs.select(F.explode(codes.positions_of(docs, self.manifest.dims)).alias("dim"), "doc_id", "weight")
        name = self._segment("postings", rows.repartitionByRange("dim", "doc_id").sortWithinPartitions("dim", "doc_id"))
        return self._publish(replace(self.manifest, version=self.manifest.version + 1, postings=name))

    def fold(self) -> int:
        """Merges all segments into one base each; ids and answers stay."""
        docs = self._segment("docs", self.docs().withColumn("live", F.lit(True)).repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
        attrs = self._segment("attrs", self.all_attrs().withColumn("live", F.lit(True)).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"))
        return self._publish(replace(self.manifest, version=self.manifest.version + 1, docs=(docs,), attrs=(attrs,)))

    # -- compaction ------------------------------------------------------------

    def compact(self) -> tuple[int, DataFrame]:
        """(source version, map new_id/old_id). Asked again while pending it gives the same map."""
        p = self.manifest.pending
        if not p:
            docs = self.docs()
            if self.residual:  # by set bits of the stored row
                docs = docs.withColumn("weight", codes.binary_weight(F.col("code"), residual.CODE_BYTES))
            name = self._segment("remap", compaction.remap(docs).repartitionByRange("new_id").sortWithinPartitions("new_id"))
            table = self._remap(name)
            moved = self.docs().withColumnRenamed("doc_id", "old_id").join(table, "old_id")
            fields = [f.split(" ")[0] for f in self._docs_schema().split(", ")]
            moved = moved.withColumnsRenamed({"new_id": "doc_id"}).withColumns({"block": codes.block_of(F.col("doc_id")), "live": F.lit(True)}).select(*fields)
            # ids follow weight, so sorted files have narrow weight ranges
            new_docs = self._segment("docs", moved.repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
            new_attrs = self._segment("attrs", compaction.retag(self.all_attrs(), table).withColumn("live", F.lit(True)).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"))
            p = {"source": self.manifest.version, "remap": name}
            self._publish(replace(self.manifest, version=self.manifest.version + 1, docs=(new_docs,), attrs=(new_attrs,), stats=None, postings=None, pending=p))
        table = self._remap(p["remap"])
        compaction.check_remap(table)
        return p["source"], table

    def _remap(self, name: str) -> DataFrame:
        return self.spark.read.schema("new_id bigint, old_id bigint").parquet(f"{self.path}/{name}")

    def acknowledge(self, source: int) -> int:
        if not self.manifest.pending or self.manifest.pending["source"] != source:
            raise CompactionMismatch(f"no pending compaction of version {source}")
        return self._publish(replace(self.manifest, version=self.manifest.version + 1, pending=None))

    def vacuum(self, keep: int = 1) -> None:
        """Drops manifests but the newest ``keep`` and the segments that no kept manifest names."""
        files = Files(self.spark)
        names = files.names(self.path)
        versions = sorted(int(n[9:-5]) for n in names if n.startswith("manifest-"))
        kept = [Manifest.from_json(files.read(f"{self.path}/{_name(v)}")) for v in versions[-keep:]]
        used = {s for m in kept for s in (*m.docs, *m.attrs, m.stats, m.postings, (m.pending or {}).get("remap"))}
        for v in versions[:-keep]:
            files.delete(f"{self.path}/{_name(v)}")
        for n in names:
            if n.split("-")[0] in ("docs", "attrs", "stats", "postings", "remap") and n not in used:
                files.delete(f"{self.path}/{n}")


def _sparse_words(dims: int):
    """Words of positions for wide codes: one pass over the positions, grouped by word."""
    n = codes.words_for(dims)
    inside = F.filter("positions", lambda p: p < dims)
    one = F.expr("1L")

    def word(i):
        mine = F.filter(inside, lambda p: F.floor(p / 64) == i)
        return F.aggregate(mine, F.expr("0L"), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", one, (p % 64).cast("int"))))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), word)


def _name(version: int) -> str:
    return f"manifest-{version:020d}.json"


def with_consistency(run, index: Index, consistency: str = "resume", tries: int = 3):
    """Calls run(index); after an expired snapshot ``resume`` reopens the newest version and repeats the whole query."""
    if consistency not in ("strict", "resume"):
        raise InvalidArgument(f"consistency {consistency!r}")
    for left in range(tries, -1, -1):
        try:
            return run(index)
        except SnapshotExpired:
            if consistency == "strict" or not left:
                raise
            root, ns = index.path.rsplit("/ns=", 1)
            index = Index.open(index.spark, root, int(ns))
    return None
