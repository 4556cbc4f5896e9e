"""Facts of clauses and their conflicts between documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Dictionaries of parties, actions with their kind of obligation, objects, condition words.
SUBJECTS = ["招标人", "投标人", "中标人", "采购人", "供应商", "承包人", "发包人", "建设单位", "甲方", "乙方", "丙方", "我公司", "我司", "我方", "本公司", "对方"]
OWNERS = ["招标人", "采购人", "甲方", "发包人", "建设单位"]
SUPPLIERS = ["投标人", "中标人", "供应商", "承包人", "乙方", "我公司", "我司", "我方", "本公司"]
OBLIGATIONS = {
    "付款义务": ["支付", "缴纳", "退还", "结算"],
    "交付义务": ["交付", "交货", "提交", "送达"],
    "保密义务": ["保密"],
    "责任义务": ["赔偿", "承担", "违约"],
    "担保义务": ["保证", "质保"],
    "服务义务": ["维护", "响应"],
    "履约义务": ["验收", "完成", "实施", "部署"],
}
OBJECTS = ["履约保证金", "投标保证金", "服务费用", "质保金", "预付款", "进度款", "尾款", "保证金", "报告", "材料", "文件", "货物", "设备", "系统", "软件"]
CONDITIONS = ["如果", "如发生", "一旦", "倘若", "若", "如", "凡", "当"]
CONDITION_CHARS = 16
FIELDS = ["amount", "duration", "date", "percentage"]
LABELS = {"amount": "金额", "duration": "工期", "date": "日期", "percentage": "比例", "subject": "责任主体"}


def _earliest(text: Column, words: list[str]) -> Column:
    """The first of ``words`` in the text, the longest of those at the same place; null for none."""
    places = F.array(*[F.struct(F.instr(text, w).alias("at"), F.lit(-len(w)).alias("size"), F.lit(w).alias("word")) for w in words])
    return F.array_min(F.filter(places, lambda p: p["at"] > 0))


def with_facts(chunks: DataFrame, text: str = "text", entities: str = "entities") -> DataFrame:
    """Add the struct ``fact``. Words come from the raw text, quantities from the entities."""
    raw, found = F.coalesce(F.col(text), F.lit("")), F.col(entities)
    kinds = {word: kind for kind, words in OBLIGATIONS.items() for word in words}
    action = _earliest(raw, list(kinds))["word"]
    obligation = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), action)
    start = _earliest(raw, CONDITIONS)["at"]

    def values(kind: str) -> Column:
        return F.array_distinct(F.transform(F.filter(found, lambda e: e["kind"] == kind), lambda e: e["value"]))

    lists = {k: values(k) for k in FIELDS}
    parts = {
        "subject": _earliest(raw, SUBJECTS)["word"], "action": action, "object": _earliest(raw, OBJECTS)["word"],
        **{k: F.get(lists[k], F.lit(0)) for k in ("amount", "date", "duration", "percentage")},
        "condition": F.substring(raw, start, F.lit(CONDITION_CHARS)),
    }
    hits = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in parts.values()), F.lit(0))
    columns = [v.alias(k) for k, v in parts.items()] + [obligation.alias("obligation_type"), (hits / 8).alias("confidence")]
    columns += [lists[k].alias(f"{k}s") for k in FIELDS]
    return chunks.withColumn("fact", F.struct(*columns))


def camp(subject: Column) -> Column:
    return F.when(subject.isin(OWNERS), "owner").when(subject.isin(SUPPLIERS), "supplier")


def fact_conflicts(facts: DataFrame) -> DataFrame:
    """``facts(group, doc, fact)`` to one row per group in conflict: group, risk, fields.

    A field is in conflict if two documents each have a value that the other has
    not; parties are if they are of both camps. fields: array of (field, values of
    (doc, value)).
    """
    sets = facts.select("group", "doc", F.explode(F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(k).alias("field"), F.array_sort(F.col(f"fact.{k}s")).alias("set")) for i, k in enumerate(FIELDS)
    ])).alias("f")).select("group", "doc", "f.*").filter(F.size("set") > 0)
    a = sets.select("group", "field", F.col("doc").alias("doc_a"), F.col("set").alias("set_a"))
    b = sets.select("group", "field", F.col("doc").alias("doc_b"), F.col("set").alias("set_b"))
    apart = (F.size(F.array_except("set_a", "set_b")) > 0) & (F.size(F.array_except("set_b", "set_a")) > 0)
    clash = a.join(b, ["group", "field"]).filter("doc_a < doc_b").filter(apart).select("group", "field").distinct()
    told = sets.select("group", "doc", "rank", "field", F.array_join("set", "、").alias("value"))
    parties = facts.select("group", "doc", F.lit(len(FIELDS)).alias("rank"), F.lit("subject").alias("field"), F.col("fact.subject").alias("value"), camp(F.col("fact.subject")).alias("camp")).filter("camp is not null")
    crossed = parties.groupBy("group", "field").agg(F.countDistinct("camp").alias("n")).filter("n > 1").select("group", "field")
    values = told.union(parties.drop("camp")).join(clash.union(crossed), ["group", "field"])
    fields = values.groupBy("group", "field", "rank").agg(F.array_sort(F.collect_list(F.struct("doc", "value"))).alias("values"))
    grouped = fields.groupBy("group").agg(
        F.array_sort(F.collect_list(F.struct("rank", "field", "values"))).alias("fields"),
        F.max((F.col("field") != "percentage").cast("int")).alias("heavy"),
    )
    sure = facts.groupBy("group").agg(F.min("fact.confidence").alias("least"))
    risk = F.when(F.col("least") < 0.2, "review").when(F.col("heavy") == 1, "high").otherwise("medium")
    fields = F.transform("fields", lambda f: F.struct(f["field"].alias("field"), f["values"].alias("values")))
    return grouped.join(sure, "group").select("group", risk.alias("risk"), fields.alias("fields"))


def apply_conflicts(clusters: DataFrame, members: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters whose primaries are in conflict change type, severity and summary; and the facts of all primaries."""
    primaries = members.filter("role = 'primary'").join(chunks.select("job_id", "cid", "doc_id", "text", "entities"), ["job_id", "cid"])
    facts = with_facts(primaries)
    named = facts.select(F.struct("job_id", "cluster_no").alias("group"), F.col("doc_id").alias("doc"), "fact")
    found = fact_conflicts(named).select(F.col("group.job_id").alias("job_id"), F.col("group.cluster_no").alias("cluster_no"), F.struct("risk", "fields").alias("conflict"))
    out = clusters.join(found, ["job_id", "cluster_no"], "left")
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    names = F.array_join(F.transform(F.col("conflict.fields.field"), lambda f: F.element_at(label, f)), "、")
    hit = F.col("conflict").isNotNull()
    out = out.withColumns({
        "cluster_type": F.when(hit, "conflict").otherwise(F.col("cluster_type")),
        "severity": F.when(hit, F.col("conflict.risk")).otherwise(F.col("severity")),
        "summary": F.when(hit, F.concat(F.lit("事实冲突："), names)).otherwise(F.col("summary")),
    })
    return out, facts.select("job_id", "cid", "doc_id", "fact")


def latest_facts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Facts are replaced by (job, chunk); the newest write wins."""
    both = stored.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("job_id", "cid").orderBy(F.desc("_age")))
    return both.withColumn("_rn", rank).filter("_rn = 1").drop("_age", "_rn")
