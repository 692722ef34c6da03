"""Whole transactions: both sides of each as arrays, and the numbers that detectors look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import TX


def assemble(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(block_num, position, ins, outs): arrays in order of identity and of vout; a side that has nothing is empty. One
    shuffle: both sides are tagged and grouped together. Extra columns reuse and alias come along where both sides have them."""
    extra = [c for c in ("reuse", "alias") if c in inputs.columns and c in outputs.columns]
    side = lambda df, tag: df.select(*TX, F.lit(tag).alias("side"), "vout", "txo_id", "node_id", "value", *extra)
    both = side(inputs, 0).unionByName(side(outputs, 1))
    of = lambda tag, first: F.array_sort(F.collect_list(F.when(F.col("side") == tag, F.struct(first, *(c for c in ("vout", "txo_id") if c != first), "node_id", "value", *extra))))
    return both.groupBy(*TX).agg(of(0, "txo_id").alias("ins"), of(1, "vout").alias("outs"))


def histogram(outputs: DataFrame) -> DataFrame:
    """(block_num, position, value, occurrences) of output values."""
    return outputs.groupBy(*TX, "value").agg(F.count(F.lit(1)).alias("occurrences"))


def _side(rows: DataFrame, name: str) -> DataFrame:
    """Counts of one side, and its histogram by falling occurrence, then by value. Rows are dealt by transaction once; both
    aggregates use that."""
    dealt = rows.repartition(*TX)
    by_value = dealt.groupBy(*TX, "value").agg(F.count(F.lit(1)).alias("c"), F.collect_set("node_id").alias("ids"), F.max((F.col("vout") == 0).cast("int")).alias("zero"))
    return by_value.groupBy(*TX).agg(
        F.sum("c").alias(f"num_{name}s"),
        F.count(F.lit(1)).alias(f"num_{name}_values"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).cast("long").alias(f"num_{name}_ids"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), F.col("value")))), lambda x: F.struct(x["value"].alias("value"), (-x["k"]).alias("count"))).alias(f"{name}_values"),
        (F.max("zero") == 1).alias(f"{name}_zero"),
        F.sum(F.col("value") * F.col("c")).alias(f"{name}_sum"),
        F.min("value").alias(f"{name}_min"),
        F.max("value").alias(f"{name}_max"),
    )


def features(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row for each transaction that has a side: num_inputs, num_outputs, num_input_ids, num_output_ids, numbers of
    values, both histograms, whether output 0 is there, the most frequent output value (the least of several) and how often
    it occurs (null without outputs)."""
    both = _side(inputs, "input").drop("input_zero").join(_side(outputs, "output"), TX, "full_outer")
    zero = ["num_inputs", "num_outputs", "num_input_values", "num_output_values", "num_input_ids", "num_output_ids"]
    out = both.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    none = F.lit(None)
    out = out.withColumns({
        "output_zero": F.coalesce("output_zero", F.lit(False)),
        "mode_value": F.when(F.size("output_values") > 0, F.col("output_values")[0]["value"]).otherwise(none),
        "mode_count": F.when(F.size("output_values") > 0, F.col("output_values")[0]["count"]).otherwise(none),
    })
    kinds = "array<struct<value:bigint,count:bigint>>"
    return out.withColumns({c: F.coalesce(F.col(c), F.from_json(F.lit("[]"), kinds)) for c in ("input_values", "output_values")})


def show_transaction(inputs: DataFrame, outputs: DataFrame, block_num: int, position: int) -> str:
    """One transaction as text; amounts in units of 10**8."""
    pick = lambda df: df.where((F.col("block_num") == block_num) & (F.col("position") == position))
    row = assemble(pick(inputs), pick(outputs)).first()
    if row is None:
        return f"no transaction {position} in block {block_num}"
    line = lambda x: f"  {x['node_id']}: {x['value'] / 1e8:.8f}" + (f" (reused at {x['reuse']})" if "reuse" in x and x["reuse"] is not None and x["reuse"] < 1_000_000 else "")
    return "\n".join([f"transaction {position} of block {block_num}", "in:", *(line(x.asDict()) for x in row.ins), "out:", *(line(x.asDict()) for x in row.outs)])
