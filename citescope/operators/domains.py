"""Registrable domains by a table of suffix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.functions import fixed_values as fixed
from citescope.functions import sql as S
from citescope.functions.sql import col, select
from citescope.operators.joins import spread_join

#: As many rules, some 30 bytes each, may be sent to the tasks; more are joined by a shuffle.
SENT_RULES = 200_000


def default_rules(spark: SparkSession) -> DataFrame:
    """``rule``: the suffixes that ``normalize_domain`` knows without a table."""
    pairs = [(f"{second}.{country}",) for country in fixed.COUNTRY_CODES for second in fixed.SECOND_LEVEL_LABELS]
    return spark.createDataFrame(pairs, "rule string")


def suffix_rules(rules: DataFrame) -> DataFrame:
    """``suffix, longest, exception`` of a list of rules, one row for each suffix.

    A rule is a suffix; ``*.suffix`` stands for all its children; ``!name`` takes a name out of
    such a rule.  Case, blanks and empty or null rules do not matter; rules may repeat."""
    rule = F.lower(F.trim("rule"))
    kind = F.when(rule.startswith("*."), 1).when(rule.startswith("!"), 2).otherwise(0)
    rows = rules.select(F.regexp_replace(rule, r"^(\*\.|!)", "").alias("suffix"), kind.alias("kind")).where("suffix <> ''")
    return rows.groupBy("suffix").agg(
        # labels of the public suffix beyond those of the rule's own name
        F.max(F.when(F.col("kind") < 2, F.col("kind"))).alias("longest"),
        F.coalesce(F.bool_or(F.col("kind") == 2), F.lit(False)).alias("exception"),
    )


def registrable_domains(hosts: DataFrame, rules: DataFrame, host_col: str = "host", sent_rules: int = SENT_RULES) -> DataFrame:
    """``host, domain`` of each distinct host: its public suffix and one label more.

    Hosts are lowered and lose a leading ``www.``.  The longest matching rule gives the
    suffix, and an exception goes before all; without a rule it is the last label.  A host
    that is a suffix itself stays as it is; a null host has an empty domain.

    Each host meets the rules once for each of its labels.  A table of rules that is small
    is broadcast; with a larger one the rows of a suffix, which may be those of most hosts,
    are spread over several tasks."""
    each = hosts.select(F.col(host_col).alias("host")).distinct()
    bare = S.regexp_replace(S.lower(col("host")), r"^www\.", "")
    labels = select(each, "host", S.split(bare, "[.]").alias("labels"))
    ends = labels.select(
        "host",
        F.size("labels").alias("size"),
        F.explode_outer(F.expr("transform(labels, (x, i) -> named_struct('depth', size(labels) - i, 'suffix', array_join(slice(labels, i + 1, size(labels)), '.')))")).alias("e"),
    ).select("host", "size", "e.depth", "e.suffix")
    known = suffix_rules(rules)
    met = ends.join(F.broadcast(known), "suffix", "left") if known.count() <= sent_rules else spread_join(ends, known, "suffix", "host")
    suffix = met.groupBy("host").agg(
        F.max(F.when(F.col("exception"), F.col("depth") - 1)).alias("excepted"),
        F.max(F.when(F.col("depth") + F.col("longest") <= F.col("size"), F.col("depth") + F.col("longest"))).alias("ruled"),
    )
    count = S.coalesce(col("excepted"), col("ruled"), 1) + 1
    found = select(suffix, "host", S.substring_index(bare, ".", S.Expr(f"-({count.sql})")).alias("domain"))
    return found.withColumn("domain", F.coalesce("domain", F.lit("")))


def with_domains(rows: DataFrame, rules: DataFrame, host_col: str = "host", spread_by: str = "host") -> DataFrame:
    """Rows with the ``domain`` of their host; a host may have a large part of all rows."""
    found = registrable_domains(rows, rules, host_col).withColumnRenamed("host", "_host")
    joined = spread_join(rows.withColumn("_host", F.col(host_col)), found, "_host", spread_by)
    return joined.withColumn("domain", F.coalesce("domain", F.lit(""))).drop("_host")
