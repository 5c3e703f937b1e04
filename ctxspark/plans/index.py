"""The user's API: build an index over sources, then search it, gather context, and report."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxspark.functions.signature import signature
from ctxspark.functions.text import first_filled, searchable_text, tokenize
from ctxspark.operators import bm25, budget, chunker, context, embed, hybrid, maintained, postings, recency, report
from ctxspark.sources import files as scanning
from ctxspark.sources import git, sinks
from ctxspark.sources.versions import Commit, Versions, bucket_of
from ctxspark.streaming import incremental


class EmptyIndex(RuntimeError):
    """Nothing is indexed yet."""


#: Changed files up to which they are read by name and each table gets one file; beyond that the root is read and joined.
NAMED_FILES = 1_000
CHUNKS = ["file", "id", "type", "name", "signature", "code", "hash", "summary", "ord"]


class Index:
    def __init__(self, spark: SparkSession, root: str, store: str | None = None, model=embed.hashing_model, cut=chunker.chunks_of) -> None:
        self.spark, self.root, self.model, self.cut = spark, root, model, cut
        self.store = Versions(spark, store or os.path.join(root, ".ctxspark", "index"))

    # --- building

    def build(self, include: list[str] | None = None, ignore: list[str] | None = None, force: bool = False) -> DataFrame:
        """Index new and changed files, drop deleted ones, keep graph and ranks up to date; returns (path, status).

        Only new and changed files are read. One that can't be parsed keeps what it had (status `failed`) and is tried again by the next build.
        Everything is written before the commit that makes it count.
        """
        if force:
            self.store.clear()
        at = self.store.last()
        files = self.store.files(at)
        current = scanning.listing(self.spark, self.root, include, ignore).select("path", F.unix_micros("mtime").cast("double").alias("mtime"))
        found = incremental.status(files, current).join(current, "path", "left").checkpoint()
        changed = found.where("status <> 'unchanged'")
        some = changed.limit(NAMED_FILES + 1).collect()
        if not some:
            return found.select("path", "status")
        small = len(some) <= NAMED_FILES
        fresh = changed.where("status in ('added', 'changed')").select("path", "mtime")
        if small:
            names = [r["path"] for r in some if r["status"] != "deleted"]
            sources = scanning.read_paths(self.spark, names) if names else None
        else:
            sources = scanning.scan(self.spark, self.root, include, ignore).join(fresh, "path", "left_semi")
        version = at.version + 1
        failed, chunks = fresh.select("path").limit(0), self.store.table("chunks", Commit())
        if sources is not None:
            cut = chunker.extract_or_error(sources, self.cut).checkpoint()
            failed = cut.where("error is not null").select(F.col("file").alias("path"))
            fresh = fresh.join(failed, "path", "left_anti")
            # of a file that failed, what it imports is as old as the rest of it
            chunks = self._write_rows(cut.where("error is null"), sources.join(failed, "path", "left_anti"), version, small)
        moved = not small or any(r["status"] in ("added", "deleted") for r in some)
        self.store.commit(self._write_list(files, fresh, chunks, changed, moved, version, at, small), at)
        self.store.compact_if_many()
        status = F.when(F.col("failed"), "failed").otherwise(F.col("status")).alias("status")
        return found.join(failed.withColumn("failed", F.lit(True)), "path", "left").select("path", status)

    def _write_rows(self, cut: DataFrame, sources: DataFrame, version: int, small: bool) -> DataFrame:
        """Chunks of new and changed files, and what comes from their text; returns the chunks."""
        chunks = chunker.last_wins(cut).withColumn("signature", signature("type", "code", "name"))
        chunks = chunks.withColumn("summary", searchable_text("file", "name", "signature", "code"))
        chunks = self.store.write("chunks", chunks.select(*CHUNKS), version, small)
        vector = embed.embedder(self.model)(first_filled("summary", "signature", "name"))
        tokens = chunks.select("file", "id", tokenize(hybrid.corpus_text()).alias("tokens"))
        tables = {
            "embeddings": chunks.select("file", F.col("id").alias("chunk_id"), vector.alias("vector")), "postings": postings.blocks(tokens),
            "specifiers": maintained.specifiers(sources),
        }
        with ThreadPoolExecutor(len(tables)) as pool:  # their jobs don't wait for each other
            for done in [pool.submit(inheritable_thread_target(self.spark)(self.store.write), name, rows, version, small) for name, rows in tables.items()]:
                done.result()
        return chunks

    def _write_list(
        self, files: DataFrame, fresh: DataFrame, chunks: DataFrame, changed: DataFrame, moved: bool, version: int, at: Commit, small: bool
    ) -> Commit:
        """Edges and ranks that differ, and the list of files that counts from now on."""
        now, key = F.lit(version).cast("long"), F.col("path").alias("file")
        sizes = chunks.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("chunks"), F.sum(F.size(tokenize(hybrid.corpus_text()))).cast("long").alias("tokens"))
        counted = fresh.join(sizes, "path", "left").fillna(0, ["chunks", "tokens"]).withColumns({"version": now, "edges_version": now})
        gone = changed.where("status = 'deleted'").select("path")
        # files that failed stay as they were; new ones among them aren't listed yet
        stays = files.join(fresh, "path", "left_anti").join(gone, "path", "left_anti")
        listed = stays.unionByName(counted.select(*stays.columns))
        again = fresh.select(key)
        if moved:
            specifiers = self.store.stored("specifiers").join(listed.select(key, "version"), ["file", "version"])
            again = again.union(maintained.touched(specifiers, changed.where("status <> 'changed'"))).distinct().checkpoint()
            mark = again.select(F.col("file").alias("path"), F.lit(True).alias("again"))
            listed = listed.join(mark, "path", "left").withColumn("edges_version", F.when(F.col("again"), now).otherwise(F.col("edges_version"))).drop("again")
        specifiers = self.store.stored("specifiers").join(listed.select(key, "version"), ["file", "version"])
        links = maintained.resolve(specifiers.join(again, "file", "left_semi"), listed)
        with ThreadPoolExecutor(2) as pool:
            run = inheritable_thread_target(self.spark)
            tables = pool.submit(run(self.store.write_files), listed, version, small), pool.submit(run(self.store.write), "edges", links, version, small)
            listed, edges = (t.result() for t in tables)
        named = lambda df: df.select(F.col("file").alias("source_file"), "target_file").distinct()
        old = named(self.store.rows("edges", at))
        new = named(self.store.stored("edges").join(listed.select(key, F.col("edges_version").alias("version")), ["file", "version"]))
        # sources whose edges differ, deleted files among them
        sources = again.union(gone.select(key)).withColumnRenamed("file", "source_file")
        both = old.join(sources, "source_file", "left_semi").withColumn("n", F.lit(1)).union(named(edges).withColumn("n", F.lit(-1)))
        differ = both.groupBy("source_file", "target_file").agg(F.sum("n").alias("n")).where("n <> 0").select(F.col("source_file").alias("file")).distinct()
        ranks = at.ranks
        if len(differ.head(1)):
            steps = maintained.updated_steps(self.store.ranks(at), old, new, differ.checkpoint()) if at.ranks else maintained.steps(new)
            self.store.write_ranks(steps, version)
            ranks = version
        row = listed.agg(F.count("*").alias("n_files"), F.sum("chunks").alias("n_chunks"), F.sum("tokens").alias("n_tokens")).first()
        return Commit(version, version, ranks, *(x or 0 for x in row))

    # --- asking

    def _at(self) -> Commit:
        at = self.store.last()
        if not at.n_chunks:
            raise EmptyIndex("no index: call build() first")
        return at

    def _chunks(self) -> DataFrame:
        return self.store.table("chunks", self._at())

    def edges(self) -> DataFrame:
        return self.store.table("graph")

    def ranks(self) -> DataFrame:
        """(file, rank), as stored with the graph."""
        return maintained.ranks(self.store.ranks())

    def recent(self, now: str | None = None) -> DataFrame:
        log = git.log(self.spark, self.root)
        now = now or self.spark.range(1).select(F.current_timestamp().cast("string")).first()[0]
        scores = recency.recency(log, now)
        return recency.match_files(self.store.files().select(F.col("path").alias("file")), scores)

    def _postings(self, terms: list[str], at: Commit) -> DataFrame:
        """Blocks of these terms that count; only their buckets are read."""
        # buckets are constants to the optimizer: partitions are pruned without a job
        wanted = reduce(lambda a, b: a | b, (F.col("bucket") == bucket_of(F.lit(t)) for t in dict.fromkeys(terms)), F.lit(False))
        stored = self.store.stored("postings").where(wanted & F.col("term").isin(terms))
        return self.store.valid("postings", stored, at)

    def keyword_search(self, query: str, k: int = 10) -> DataFrame:
        """The k best chunks by BM25 alone: (id, score). Blocks that can't hold one of them aren't opened."""
        at, terms = self._at(), bm25.query_tokens(self.spark, query)
        return postings.top_k(self._postings(terms, at), terms, k, at.n_chunks, at.n_tokens / at.n_chunks)

    def search(self, query: str, k: int = 10, weights: hybrid.Weights = hybrid.Weights(), use_git: bool = True) -> DataFrame:
        """The k best chunks by all signals. Reads postings, vectors, ranks and names; no text, no graph."""
        at, terms = self._at(), bm25.query_tokens(self.spark, query)
        lexical = postings.scores(self._postings(terms, at), terms, at.n_chunks, at.n_tokens / at.n_chunks)
        return hybrid.search(
            self.store.table("chunks", at).select("id", "file", "name", "signature"), query, k, weights=weights, terms=terms, lexical=lexical,
            embeddings=self.store.table("embeddings", at), query_vector=self.model()([query])[0], ranks=maintained.ranks(self.store.ranks(at)),
            recent=self.recent() if use_git else None,
        )

    def packed_search(self, query: str, k: int = 10, model: str | None = None, max_tokens: int | None = None) -> DataFrame:
        return context.pack_search(self.search(query, k), max_tokens or budget.token_budget(model))

    def context(self, task: str, file: str | None = None, k: int = 15, tokens: int | None = None) -> DataFrame:
        listed = context.entries(self._chunks(), self.edges(), self.search(task, k), file)
        return context.pack_cli(listed, tokens) if tokens else listed

    def packed_context(self, task: str, file: str | None = None, k: int = 15, model: str | None = None, max_tokens: int | None = None) -> DataFrame:
        return context.pack_tool(self._chunks(), self.edges(), self.search(task, k), file, max_tokens or budget.token_budget(model))

    def context_text(self, task: str, file: str | None = None, style: str = "text", k: int = 15, tokens: int | None = None) -> DataFrame:
        """One row: the context as text, markdown, a prompt, or json."""
        listed = self.context(task, file, k, tokens)
        if style == "json":
            return sinks.context_json(listed, task, file)
        return sinks.render(listed, sinks.CONTEXT[style], task=task, target=file or "")

    def diff_text(self, task: str, base: str = "main", style: str = "text", changed: DataFrame | None = None) -> DataFrame:
        """One row: changed chunks, their dependencies and related code as text or markdown."""
        found = self.diff(task, base, changed)
        order = Window.orderBy("file", "ord", "id")  # chunks of changed files, and lists of 20 and 10
        parts = [found[s].withColumn("position", F.row_number().over(order)).select(F.lit(s).alias("section"), "position", "file", "name", "signature") for s in ("changed", "dependencies")]
        best = Window.orderBy(F.desc("score"), "id")
        related = found["related"].withColumn("position", F.row_number().over(best)).select(F.lit("related").alias("section"), "position", "file", "name", "signature")
        return sinks.render(parts[0].union(parts[1]).union(related), sinks.DIFF[style], task=task)

    def auto(self, message: str, file: str) -> DataFrame:
        return context.pack_auto(self._chunks(), self.edges(), self.search(message, 10), file)

    def diff(self, task: str | None = None, base: str = "main", changed: DataFrame | None = None) -> dict[str, DataFrame]:
        """changed, dependencies and, for a task, related chunks."""
        chunks, edges = self._chunks(), self.edges()
        changed = git.changed(self.spark, self.root, base) if changed is None else changed
        out = {"changed": context.changed_chunks(chunks, changed), "dependencies": context.diff_dependencies(chunks, edges, changed)}
        if task:
            out["related"] = context.diff_related(chunks, edges, changed, self.search(task, context.DIFF_RELATED))
        return out

    # --- reporting

    def stats(self) -> DataFrame:
        return report.stats(self.store.table("chunks"), self.store.table("embeddings"), self.edges())

    def explain(self) -> dict[str, DataFrame]:
        chunks, edges = self._chunks(), self.edges()
        return {
            "types": report.by_type(chunks),
            "layers": report.layers(chunks),
            "names": report.names_per_file(chunks),
            "important": report.important_files(self.ranks(), chunks),
            "importers": report.top_importers(edges),
        }

    def instructions(self) -> DataFrame:
        return report.instructions(self._chunks())
