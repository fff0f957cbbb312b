"""Rules on query plans and SQL texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Statement words that a read-only query must not hold.
UNSAFE_WORDS = ["INSERT", "UPDATE", "DELETE", "DROP", "TRUNCATE", "ALTER", "CREATE", "REPLACE", "MERGE"]
# Words that mark a question about internal documents.
INTERNAL_WORDS = [
    "보고서", "연례 보고서", "연간 보고서", "요약", "문서", "내부 문서", r"제\d+회", r"제\d+차", "백서", "지침", "가이드라인", "매뉴얼", "정책서", "규정집", "내규", "기술 문서", "설명서", "공문",
    "annual report", "report", "document", "summary", "white paper", "guideline", "manual", "policy", "regulation", "bulletin",
]
TASK_TYPES = ["document", "web", "quantitative", "mixed"]
UNSAFE = r"(?i)\b(" + "|".join(UNSAFE_WORDS) + r")\b"
INTERNAL = "(?i)" + "|".join(INTERNAL_WORDS)
FIRST_TABLE = r"(?i)\bFROM\s+([a-zA-Z_][a-zA-Z0-9_]*)"


def unsafe(sql: Column) -> Column:
    return sql.rlike(UNSAFE)


def first_table(sql: Column) -> Column:
    return F.regexp_extract(sql, FIRST_TABLE, 1)


def overridden_type(task_type: Column, query: Column) -> Column:
    return F.when((task_type == "web") & query.rlike(INTERNAL), F.lit("document")).otherwise(task_type)


def valid_type(task_type: Column) -> Column:
    return F.when(task_type.isin(TASK_TYPES), task_type).otherwise(F.lit("document"))


# Functions that call any static method of the JVM.
CALLS = re.compile(r"(?i)\b(try_)?(reflect|java_method)`?\s*\(")
# Names of the logical plans of queries; everything else, commands and scripts above all, is refused.
QUERY_PLANS = frozenset(
    "Project Filter Aggregate Sort Distinct Deduplicate Join LateralJoin AsOfJoin Union Intersect Except Window WindowGroupLimit Generate Expand Sample Pivot Unpivot Offset Tail "
    "GlobalLimit LocalLimit SubqueryAlias View UnresolvedRelation UnresolvedInlineTable UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedTableValuedFunction UnresolvedTVFAliases "
    "UnresolvedHint UnresolvedWindow WithWindowDefinition OneRowRelation LocalRelation Range ResolvedInlineTable WithCTE CTERelationDef CTERelationRef RepartitionByExpression Repartition UnresolvedOrdinal".split()
)


def _plans(plan, found: set[str]) -> set[str]:
    """Class names of a parsed plan with all its inner plans: children, named subqueries, subqueries of expressions."""
    found.add(plan.getClass().getSimpleName())
    for inner in (plan.children(), plan.innerChildren(), plan.subqueries()):
        at = inner.iterator()
        while at.hasNext():
            node = at.next()
            if node.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans.logical") or "Unresolved" in node.getClass().getSimpleName():
                _plans(node, found)
    return found


def is_select(spark: SparkSession, sql: str) -> bool:
    """Does Spark's own parser read the text as one query? Commands, scripts, ``EXECUTE IMMEDIATE`` and ``CALL`` are none."""
    if CALLS.search(sql):
        return False
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        return _plans(plan, set()) <= QUERY_PLANS
    except Exception:
        return False
