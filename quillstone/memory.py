"""The memory store as one object: drawers, facts, tags, tunnels, diary and search over versioned tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import embedding as em
from quillstone.functions import text as tx
from quillstone.operators import bm25, census, graph, search
from quillstone.operators import store as st
from quillstone.session import staged
from quillstone.sources import files

DRAWERS = (
    "id string, wing string, room string, title string, text string, embedding array<float>, filed_at timestamp_ntz, source_file string, "
    "chunk_index int, parent_drawer_id string, added_by string"
)
TRIPLES = (
    "id string, subject string, predicate string, object string, confidence float, valid_from timestamp_ntz, valid_to timestamp_ntz, "
    "source_closet string, current boolean, created_at timestamp_ntz"
)
TAGS = "drawer_id string, tag string, created_at timestamp_ntz"
TUNNELS = (
    "id string, source_wing string, source_room string, source_drawer_id string, target_wing string, target_room string, "
    "target_drawer_id string, label string, kind string, created_at timestamp_ntz"
)
SCHEMAS = {"drawers": DRAWERS, "kg_triples": TRIPLES, "drawer_tags": TAGS, "tunnels": TUNNELS}
#: What spreads the rows of a table over the buckets of the store: a drawer stands with its chunks.
KEYS = {
    "drawers": lambda: F.coalesce(F.nullif("parent_drawer_id", F.lit("")), F.col("id")),
    "kg_triples": lambda: F.col("id"),
    "drawer_tags": lambda: F.col("drawer_id"),
    "tunnels": lambda: F.col("id"),
}
SIMILAR = 0.9
ITEM = "wing string, room string, title string, text string, source_file string, added_by string"


def _utc() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


class Memory:
    """Operations on a store; every change is a new version of a table.

    embed: texts to vectors. clock: the present second as 'YYYY-MM-DD HH:MM:SS'. The keyword index is
    kept until a change to the drawers makes it stale.
    """

    def __init__(self, spark: SparkSession, root: str, embed: em.Embed = em.hashed, clock: Callable[[], str] = _utc, rows_per_bucket: int = 200_000) -> None:
        self.spark, self.store, self.embed, self.clock = spark, st.Store(spark, root, rows_per_bucket), embed, clock
        self._index: tuple[int, bm25.Index] | None = None

    # --- tables ---

    def table(self, name: str) -> DataFrame:
        found = self.store.read(name)
        return self.spark.createDataFrame([], SCHEMAS[name]) if found is None else found

    def _change(self, name: str, make: Callable[[DataFrame], DataFrame], touching: DataFrame | None = None) -> None:
        """Change a table, or only the buckets that the rows of touching fall into."""
        self.store.change(name, lambda base: make(self.spark.createDataFrame([], SCHEMAS[name]) if base is None else base), KEYS[name](), touching)

    def _near(self, name: str, touching: DataFrame) -> DataFrame:
        found = self.store.near(name, KEYS[name](), touching)
        return self.spark.createDataFrame([], SCHEMAS[name]) if found is None else found

    def _find(self, drawer_id: str):
        """(the row or None, what names its bucket): a drawer is looked up in one bucket, a chunk known by its own id in all."""
        kind = "id string, parent_drawer_id string"
        key = self.spark.createDataFrame([(drawer_id, None)], kind)
        row = self._near("drawers", key).where(F.col("id") == drawer_id).drop("embedding").first()
        if row is None:
            row = self.table("drawers").where(F.col("id") == drawer_id).drop("embedding").first()
            if row is not None:
                key = self.spark.createDataFrame([(drawer_id, row["parent_drawer_id"])], kind)
        return row, key

    def _now(self):
        return F.lit(self.clock()).cast("timestamp_ntz")

    # --- drawers ---

    def _planned(self, items: DataFrame) -> DataFrame:
        """items (wing, room, title, text, source_file, added_by) as rows to store."""
        extra = items.select(tx.drawer_id("wing", "room", "text").alias("_k"), "source_file", "added_by").dropDuplicates(["_k"])
        rows = st.plan_rows(items.select("wing", "room", "title", "text")).dropDuplicates(["id"])
        rows = rows.withColumn("_k", F.coalesce("parent_drawer_id", "id")).join(extra, "_k").withColumn("filed_at", self._now())
        return em.embedded(rows, "embed_source", self.embed).select(*[c.split()[0] for c in DRAWERS.split(", ")])

    def add_drawers(self, items: DataFrame) -> None:
        """Upsert many (wing, room, text[, title, source_file, added_by]) in one version."""
        for name in ("title", "source_file", "added_by"):
            if name not in items.columns:
                items = items.withColumn(name, F.lit(None).cast("string"))
        items = items.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), tx.derive_title("text")))
        planned = staged(self._planned(items), "planned")
        self._change("drawers", lambda base: st.replace_drawers(base, planned), planned.select("id", "parent_drawer_id"))

    def add_drawer(self, wing: str, room: str, title: str, text: str, source_file: str | None = None, added_by: str | None = None) -> str:
        one = self.spark.createDataFrame([(wing, room, title, text, source_file, added_by)], ITEM)
        self.add_drawers(one)
        return one.select(tx.drawer_id("wing", "room", "text")).first()[0]

    def get_drawer(self, drawer_id: str) -> dict:
        row, _ = self._find(drawer_id)
        if row is None:
            raise KeyError(drawer_id)
        return row.asDict()

    def update_drawer(self, drawer_id: str, text: str | None = None, title: str | None = None, wing: str | None = None, room: str | None = None) -> None:
        """Change a drawer under its old id and filing time; its chunks are planned anew."""
        found, key = self._find(drawer_id)
        if found is None:
            raise KeyError(drawer_id)
        old = found.asDict()
        new = {"wing": wing or old["wing"], "room": room or old["room"], "title": title or old["title"], "text": old["text"] if text is None else text}
        rows = self._planned(self.spark.createDataFrame([(*new.values(), old["source_file"], old["added_by"])], ITEM))
        child = F.col("chunk_index").isNotNull()
        rows = rows.withColumn("id", F.when(child, tx.chunk_id(F.lit(drawer_id), "chunk_index")).otherwise(F.lit(drawer_id)))
        rows = rows.withColumn("parent_drawer_id", F.when(child, F.lit(drawer_id))).withColumn("filed_at", F.when(child, F.col("filed_at")).otherwise(F.lit(old["filed_at"]).cast("timestamp_ntz")))
        self._change("drawers", lambda base: st.replace_drawers(base, rows), key)

    def delete_drawer(self, drawer_id: str) -> dict:
        _, key = self._find(drawer_id)
        d = self._near("drawers", key)
        hit = d.where((F.col("id") == drawer_id) | (F.col("parent_drawer_id") == drawer_id)).select("id")
        n = hit.count()
        if not n:
            return {"success": False, "drawer_id": drawer_id, "chunks_deleted": 0}
        self._change("drawers", lambda base: st.delete_drawers(base, key.select("id")), key)
        return {"success": True, "drawer_id": drawer_id, "chunks_deleted": n - 1}

    def delete_by_source(self, source_file: str, dry_run: bool = True) -> dict:
        """Rows of a source, chunks included: a count and five samples, or their removal."""
        hit = self.table("drawers").where(F.col("source_file") == source_file)
        out = {"count": hit.count(), "sample": [r[0] for r in hit.select("id").orderBy("id").limit(5).collect()], "deleted": not dry_run}
        if not dry_run:
            self._change("drawers", lambda base: base.where(F.col("source_file").isNull() | (F.col("source_file") != source_file)))
        return out

    def list_drawers(self, wing: str | None = None, room: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        return census.list_page(self.table("drawers"), limit, offset, wing, room)

    # --- search ---

    def index(self) -> bm25.Index:
        version = self.store.version("drawers")["number"]
        if self._index is None or self._index[0] != version:
            self._index = (version, bm25.build(bm25.units(self.table("drawers")), clustered=True))
        return self._index[1]

    def search(self, query: str, limit: int = 10, wing: str | None = None, room: str | None = None, tag_filter: list[str] | None = None) -> DataFrame:
        vector = self.embed([query])[0]
        return search.hybrid_search(self.table("drawers"), self.index(), query, vector, limit, wing, room, self.table("drawer_tags"), tag_filter)

    def check_duplicate(self, text: str, threshold: float = SIMILAR) -> DataFrame:
        return search.check_duplicate(self.table("drawers"), self.embed([text])[0], threshold)

    def _embedded(self, texts: list[str]) -> list:
        """The vector of each text, or the error it raised."""
        try:
            return list(self.embed(texts)) if texts else []
        except Exception:  # noqa: BLE001
            out = []
            for t in texts:
                try:
                    out.append(self.embed([t])[0])
                except Exception as e:  # noqa: BLE001
                    out.append(e)
            return out

    def checkpoint(self, items: list[dict], diary: dict | None = None) -> dict:
        """Add items in order, later ones seeing earlier ones: {added, duplicates, errors, diary}; errors stay with their item.

        One search over the store for all items, comparisons among the items here (a list of the
        caller, so its pairs are few), and one change of the store.
        """
        out: dict = {"added": [], "duplicates": [], "errors": [], "diary": None}
        fit = []
        for n, item in enumerate(items):
            lacks = [k for k in ("wing", "room", "text") if not item.get(k)]
            if lacks:
                out["errors"].append({"item": n, "error": f"item lacks {', '.join(lacks)}"})
            else:
                fit.append(n)
        vectors = dict(zip(fit, self._embedded([items[n]["text"] for n in fit])))
        out["errors"] += [{"item": n, "error": str(v)} for n, v in vectors.items() if isinstance(v, Exception)]
        vectors = {n: [float(x) for x in v] for n, v in vectors.items() if not isinstance(v, Exception)}
        if vectors:
            near = self._nearest_logical(vectors)
            rows = [(items[n]["wing"], items[n]["room"], items[n].get("title"), items[n]["text"], items[n].get("source_file"), items[n].get("added_by")) for n in vectors]
            named = self.spark.createDataFrame(rows, ITEM).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), tx.derive_title("text")))
            named = named.select(tx.drawer_id("wing", "room", "text").alias("id"), "title").collect()
            chosen: list[int] = []
            stored: list[tuple[str, list[float]]] = []
            for at, (n, v) in enumerate(vectors.items()):
                best = [(1.0 - d / 2.0, i) for i, d in near.get(n, [])]
                best += [(1.0 - round(sum((a - b) ** 2 for a, b in zip(v, w)), search.DIGITS) / 2.0, i) for i, w in stored if len(w) == len(v)]
                alike = sorted((-s, i) for s, i in best if s >= SIMILAR)
                if alike:
                    out["duplicates"].append({"item": n, "id": alike[0][1]})
                    continue
                chosen.append(at)
                # What a later item is compared with is what the row embeds: the title of a long one.
                own = v if len(items[n]["text"]) <= tx.CHUNK else self.embed([named[at]["title"]])[0]
                stored = [(i, w) for i, w in stored if i != named[at]["id"]] + [(named[at]["id"], [float(x) for x in own])]
                out["added"].append(named[at]["id"])
            if chosen:
                self.add_drawers(self.spark.createDataFrame([rows[at] for at in chosen], ITEM))
        if diary:
            out["diary"] = self.diary_write(**diary)
        return out

    def _nearest_logical(self, vectors: dict[int, list[float]]) -> dict[int, list[tuple[str, float]]]:
        """{item: [(id, squared distance)]} of the nearest logical drawer."""
        base = census.logical(self.table("drawers")).select("id", "embedding")
        found: dict[int, list[tuple[str, float]]] = {}
        for dim in {len(v) for v in vectors.values()}:
            queries = self.spark.createDataFrame([(n, v) for n, v in vectors.items() if len(v) == dim], "query_id int, embedding array<double>")
            for r in search.knn_batch(base, queries, 1).collect():
                found.setdefault(r["query_id"], []).append((r["id"], r["dist"]))
        return found

    # --- diary ---

    def diary_write(self, agent: str, topic: str, entry: str, wing: str | None = None) -> str:
        return self.add_drawer(wing or f"wing_{agent}", "diary", topic, entry, added_by=agent)

    def diary_writes(self, entries: DataFrame) -> None:
        """Many (agent, topic, entry) in one change."""
        self.add_drawers(entries.select(F.concat(F.lit("wing_"), "agent").alias("wing"), F.lit("diary").alias("room"), F.col("topic").alias("title"), F.col("entry").alias("text"), F.lit(None).cast("string").alias("source_file"), F.col("agent").alias("added_by")))

    def diary_read(self, agent: str, limit: int = 3, wing: str | None = None) -> DataFrame:
        d = search.scoped(self.table("drawers"), wing or f"wing_{agent}", "diary")
        return d.select("id", "title", "text", "filed_at").orderBy(F.desc_nulls_last("filed_at"), F.desc("id")).limit(limit)

    # --- facts ---

    def kg_adds(self, rows: DataFrame) -> None:
        """Append many facts (id, subject, predicate, object[, confidence, source_closet]): current, open, created now."""
        names = [c.split()[0] for c in TRIPLES.split(", ")]
        default = {"confidence": F.lit(1.0), "current": F.lit(True), "created_at": self._now()}
        kind = {f.name: f.dataType for f in self.spark.createDataFrame([], TRIPLES).schema}
        rows = rows.select(*[(F.col(c) if c in rows.columns else default.get(c, F.lit(None))).cast(kind[c]).alias(c) for c in names])
        self._change("kg_triples", lambda base: base.unionByName(rows), rows)

    def kg_add(self, fact_id: str, subject: str, predicate: str, obj: str, confidence: float = 1.0, valid_from: str | None = None, source_closet: str | None = None) -> None:
        row = self.spark.createDataFrame([(fact_id, subject, predicate, obj, confidence, source_closet)], "id string, subject string, predicate string, object string, confidence float, source_closet string")
        start = files.normalize_time(F.lit(valid_from)) if valid_from else F.lit(None).cast("timestamp_ntz")
        row = row.withColumn("valid_from", start).withColumn("valid_to", F.lit(None).cast("timestamp_ntz")).withColumn("current", F.lit(True)).withColumn("created_at", self._now())
        self._change("kg_triples", lambda base: base.unionByName(row), row)

    def kg_invalidate(self, fact_id: str | None = None, triple: tuple[str, str, str] | None = None) -> int:
        t = self.table("kg_triples")
        graph.close_facts(t, self.clock(), fact_id, triple)
        match = F.col("id") == fact_id if fact_id is not None else (F.col("subject") == triple[0]) & (F.col("predicate") == triple[1]) & (F.col("object") == triple[2])
        n = t.where(match).count()
        if n:
            self._change("kg_triples", lambda base: graph.close_facts(base, self.clock(), fact_id, triple))
        return n

    def kg_query(self, entity: str, direction: str = "both", as_of: str | None = None) -> DataFrame:
        return graph.facts_about(self.table("kg_triples"), entity, direction, as_of)

    # --- tags and tunnels ---

    def tag(self, drawer_id: str, tag: str) -> None:
        self.tag_all(self.spark.createDataFrame([(drawer_id, tag)], "drawer_id string, tag string"))

    def tag_all(self, pairs: DataFrame) -> None:
        """Add (drawer_id, tag) pairs; one that is there keeps its time."""
        rows = pairs.select("drawer_id", "tag").distinct().withColumn("created_at", self._now())
        self._change("drawer_tags", lambda base: base.unionByName(rows.join(base, ["drawer_id", "tag"], "left_anti")), rows)

    def untag(self, drawer_id: str, tag: str) -> None:
        one = self.spark.createDataFrame([(drawer_id,)], "drawer_id string")
        self._change("drawer_tags", lambda base: base.where(~((F.col("drawer_id") == drawer_id) & (F.col("tag") == tag))), one)

    def create_tunnel(self, source: tuple[str, str], target: tuple[str, str], label: str | None = None, source_drawer_id: str | None = None, target_drawer_id: str | None = None) -> str:
        """Link two (wing, room) that hold drawers; the latest orientation wins, the first time stays.

        If the drawers cannot be read, the link is made all the same.
        """
        for wing, room in (source, target):
            if st.has_row(lambda: self.table("drawers"), (F.col("wing") == wing) & (F.col("room") == room)) is False:
                raise ValueError(f"no drawers in {wing}/{room}")
        row = self.spark.createDataFrame([(*source, source_drawer_id, *target, target_drawer_id, label)], "source_wing string, source_room string, source_drawer_id string, target_wing string, target_room string, target_drawer_id string, label string")
        row = row.withColumn("kind", F.lit("explicit")).withColumn("created_at", self._now())
        self._link(row)
        return row.select(tx.tunnel_id("source_wing", "source_room", "target_wing", "target_room")).first()[0]

    def create_tunnels(self, rows: DataFrame) -> None:
        """Many links in order of created_at, then the given id; those with an end that holds no drawers are left out."""
        ends = self.table("drawers").select("wing", "room").distinct()
        for s in ("source", "target"):
            rows = rows.join(ends.select(F.col("wing").alias(f"{s}_wing"), F.col("room").alias(f"{s}_room")), [f"{s}_wing", f"{s}_room"], "left_semi")
        self._link(rows)

    def _link(self, rows: DataFrame) -> None:
        names = [c.split()[0] for c in TUNNELS.split(", ")]
        order = F.struct("created_at", F.col("id") if "id" in rows.columns else F.lit(""))
        rows = rows.withColumn("_o", order).withColumn("id", tx.tunnel_id("source_wing", "source_room", "target_wing", "target_room"))
        last = rows.groupBy("id").agg(F.max(F.struct("_o", *[c for c in names if c not in ("id", "created_at")])).alias("l"), F.min("created_at").alias("created_at"))
        fresh = last.select("id", "l.*", "created_at").select(*names)

        def link(base: DataFrame) -> DataFrame:
            first = base.groupBy("id").agg(F.min("created_at").alias("_first"))
            return st.upsert(base, fresh.join(first, "id", "left").withColumn("created_at", F.coalesce("_first", "created_at")).drop("_first"), ["id"])

        self._change("tunnels", link, fresh)

    def delete_tunnel(self, tunnel_id: str) -> None:
        one = self.spark.createDataFrame([(tunnel_id,)], "id string")
        self._change("tunnels", lambda base: base.where(F.col("id") != tunnel_id), one)

    # --- bulk loads ---

    def load_drawers(self, rows: DataFrame) -> None:
        """Upsert exported rows by id; missing titles are derived, missing times are now, bodies are embedded. Running twice changes nothing more."""
        title = F.substring(F.coalesce(F.nullif("title", F.lit("")), tx.derive_title(F.coalesce("text", F.lit("")))), 1, tx.TITLE_MAX)
        filed = F.coalesce(files.normalize_time(F.col("filed_at").cast("string")), self._now())
        rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("title", title).withColumn("filed_at", filed)
        rows = em.embedded(st.latest(rows, ["id"], [F.desc("filed_at"), F.desc("text")]), "text", self.embed).select(*[c.split()[0] for c in DRAWERS.split(", ")])
        rows = staged(rows, "loaded")
        # Of all buckets, as a row may have had another parent before.
        self._change("drawers", lambda base: st.upsert(base, rows, ["id"]))

    def load_facts(self, rows: DataFrame) -> None:
        """Upsert exported facts by id: confidence 1, current, created now where missing."""
        time = lambda c: files.normalize_time(F.col(c).cast("string"))
        rows = rows.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)).cast("float")).withColumn("current", F.coalesce("current", F.lit(True)))
        rows = rows.withColumn("valid_from", time("valid_from")).withColumn("valid_to", time("valid_to")).withColumn("created_at", F.coalesce(time("created_at"), self._now()))
        rows = st.latest(rows, ["id"], [F.desc("created_at"), F.desc("object"), F.desc_nulls_last("valid_from"), F.desc("confidence")]).select(*[c.split()[0] for c in TRIPLES.split(", ")])
        rows = staged(rows, "loaded")
        self._change("kg_triples", lambda base: st.upsert(base, rows, ["id"]), rows)

    def rechunk(self) -> dict:
        """Plan all logical drawers anew under their ids; the numbers of sources and of rows."""
        d = census.logical(self.table("drawers")).withColumn("chunk_index", F.lit(None).cast("int"))
        long_ = d.where(F.length("text") > tx.CHUNK)
        child = long_.select(F.col("id").alias("parent_drawer_id"), "wing", "room", "title", "source_file", "added_by", "filed_at", F.explode(tx.chunks("text")).alias("c"))
        child = child.select(tx.chunk_id("parent_drawer_id", F.col("c.chunk_index")).alias("id"), "wing", "room", "title", F.col("c.text").alias("text"), "filed_at", "source_file", "c.chunk_index", "parent_drawer_id", "added_by")
        rows = d.drop("embedding").unionByName(child)
        body = em.embedded(rows, "text", self.embed).select(*[c.split()[0] for c in DRAWERS.split(", ")])
        out = {"sources": d.count(), "emitted": rows.count()}
        self._change("drawers", lambda base: body)
        return out

    # --- counts ---

    def status(self) -> DataFrame:
        return census.status(self.table("drawers"))

    def kg_stats(self) -> DataFrame:
        return census.fact_stats(self.table("kg_triples"))
