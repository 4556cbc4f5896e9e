"""The comparison of many jobs in one plan: chunks to recall, scores, clusters, facts and job results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import CompareConfig
from tessera.operators import aggregate, chunk, cluster, evidence, facts


def jobs_of_documents(docs: DataFrame) -> DataFrame:
    """Ten documents of neighbouring ids are one job: doc_id div 10."""
    return docs.withColumn("job_id", F.expr("doc_id div 10"))


def comparable_chunks(chunks: DataFrame, config: CompareConfig) -> DataFrame:
    """Drop headings, other scopes, templates and chunks without tokens; add rel_pos."""
    out = chunk.with_rel_pos(chunks.filter("chunk_type != 'heading'"), ["job_id", "doc_id"])
    if config.scope != "full":
        out = out.filter(F.col("section_kind") != {"tech": "business", "business": "tech"}[config.scope])
    if config.ignore_templates and "is_template" in out.columns:
        out = out.filter("not is_template")
    return out.filter(F.size("tokens") > 0)


def job_documents(docs: DataFrame) -> DataFrame:
    """(job_id, doc_id, text) with the documents of a job in one partition, one after another.

    Chunks made of them by row are so too (``grouped``): the only shuffle is of the texts.
    """
    return jobs_of_documents(docs.select("doc_id", "text")).repartition("job_id").sortWithinPartitions("job_id", "doc_id")


def document_chunks(docs: DataFrame, config: CompareConfig | None = None) -> DataFrame:
    """Comparable paragraph chunks of ``docs(doc_id, text)``, ten documents a job, ``grouped`` by job."""
    config = config or CompareConfig()
    chunks = chunk.paragraph_chunks(job_documents(docs))
    chunks = chunk.with_features(chunks, config.language, config.ignore_case, config.ignore_punctuation, config.ignore_whitespace)
    return comparable_chunks(chunks, config)


@dataclass
class CompareResult:
    """Lazy result tables of a comparison. Only ``found`` is persisted: the kept pairs, clusters and what they need of chunks.

    ``grouped`` says that the rows of a job in ``chunks`` lie in one partition one after another.
    """

    chunks: DataFrame
    config: CompareConfig
    base_docs: DataFrame | None = None
    vectors: DataFrame | None = None
    metadata: DataFrame | None = None
    grouped: bool = False

    @property
    def semantic(self) -> bool:
        return self.config.enable_semantic and self.vectors is not None

    @property
    def semantic_degraded(self) -> bool:
        """vectors were asked for and there are none."""
        return self.config.enable_semantic and self.vectors is None

    @property
    def _vectors(self) -> DataFrame | None:
        return self.vectors if self.semantic else None

    @cached_property
    def candidates(self) -> DataFrame:
        return self.scored

    @cached_property
    def scored(self) -> DataFrame:
        """All candidates. They are as many as chunks squared in a job; what else needs them is made where they are."""
        return evidence.scored_pairs(self.chunks, self.config, self._vectors, self.grouped)

    @cached_property
    def found(self) -> DataFrame:
        return evidence.evidence(self.chunks, self.config, self._vectors, self.base_docs, self.grouped).persist()

    def _found(self, kind: str, column: str) -> DataFrame:
        return self.found.filter(F.col("kind") == kind).select("job_id", f"{column}.*")

    @cached_property
    def edges(self) -> DataFrame:
        return self._found("edge", "edge")

    @cached_property
    def kept(self) -> DataFrame:
        """The edges alone, for a reader of nothing else."""
        return evidence.scored_pairs(self.chunks, self.config, self._vectors, self.grouped, kept=True)

    @cached_property
    def nodes(self) -> DataFrame:
        """The chunks at the ends of edges, with the columns that ``chunks`` has but normalized and tokens."""
        return self.found.filter("kind = 'node'").select("chunk.*")

    @cached_property
    def docs(self) -> DataFrame:
        """One row per document with chunks: its chunks, characters and amounts."""
        return self._found("doc", "doc")

    @cached_property
    def best(self) -> DataFrame:
        return evidence.chunk_best(self.chunks, self.config, self._vectors, self.grouped)

    @cached_property
    def raw_clusters(self) -> DataFrame:
        return self._found("cluster", "cluster")

    @cached_property
    def members(self) -> DataFrame:
        return cluster.cluster_members(self.raw_clusters)

    @cached_property
    def _with_facts(self) -> tuple[DataFrame, DataFrame | None]:
        found = cluster.classified_clusters(self.raw_clusters, self.nodes, self.base_docs, self.config.detect_moved_paragraph)
        if not self.config.enable_fact_conflict:
            return found, None
        return facts.apply_conflicts(found, self.members, self.nodes)

    @property
    def clusters(self) -> DataFrame:
        return self._with_facts[0]

    @property
    def facts(self) -> DataFrame | None:
        return self._with_facts[1]

    @cached_property
    def deleted(self) -> DataFrame | None:
        return None if self.base_docs is None else cluster.deleted_chunks(self.found.filter("kind = 'lone'").select("chunk.*", "best"))

    @cached_property
    def matrix(self) -> DataFrame:
        """Pairs of primaries that no channel recalled count with their lexical score."""
        pairs = self._found("pair", "edge").select("job_id", "a", "b", "final_score")
        totals = self.docs.select("job_id", "doc_id", F.col("chars").alias("total"))
        return aggregate.doc_matrix(self.members.filter("role = 'primary'"), pairs, self.nodes, totals)

    @cached_property
    def sections(self) -> DataFrame:
        return aggregate.section_heat(self.best)

    @cached_property
    def shared_terms(self) -> DataFrame:
        return aggregate.shared_terms(self.chunks, grouped=self.grouped)

    @cached_property
    def price_pairs(self) -> DataFrame:
        return aggregate.price_proximity(aggregate.max_amounts(self.docs), aggregate.cluster_overlaps(self.members, self.nodes))

    @cached_property
    def flags(self) -> DataFrame:
        if self.metadata is not None:
            return aggregate.metadata_flags(self.metadata)
        return self.chunks.sparkSession.createDataFrame([], "job_id long, doc_id long, flag string, value string, n_docs long")

    @cached_property
    def collusion(self) -> DataFrame:
        return aggregate.job_collusion(self.docs, aggregate.matrix_peaks(self.matrix), self.clusters, self.flags, self.shared_terms, self.price_pairs)

    @cached_property
    def summary(self) -> DataFrame:
        return aggregate.summary(self.clusters, self.docs)

    def of_job(self, job_id: int) -> CompareResult:
        """The comparison of one job alone: its report then costs one job, however many there are."""
        one = [None if t is None else t.filter(F.col("job_id") == job_id) for t in (self.chunks, self.base_docs, self.vectors, self.metadata)]
        return CompareResult(one[0].persist(), self.config, *one[1:], self.grouped)

    def unpersist(self) -> None:
        if "found" in self.__dict__:
            self.found.unpersist()
        self.chunks.unpersist()


def compare(chunks: DataFrame, config: CompareConfig | None = None, base_docs: DataFrame | None = None, vectors: DataFrame | None = None, metadata: DataFrame | None = None, grouped: bool = False) -> CompareResult:
    """Compare comparable ``chunks`` (see ``document_chunks``, whose chunks are ``grouped``) job by job.

    ``vectors(job_id, cid, doc_id, vector)`` turns the semantic dimension on if the
    configuration asks for it; ``base_docs(job_id, base_doc)`` turns base mode on;
    ``metadata(job_id, doc_id, author, last_modified_by)`` feeds the collusion score.
    """
    return CompareResult(chunks, config or CompareConfig(), base_docs, vectors, metadata, grouped)
