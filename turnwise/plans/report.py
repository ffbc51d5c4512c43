"""From result files to the comparison report.

A report is a table of text lines with a sort key ``(section, item)``. Nothing is gathered into one row or the driver;
``write_lines`` sorts by the key, so the part files joined in name order are the document (one file for a usual report).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnwise.functions.text import fixed, gain_text, iso_timestamp, run_timestamp
from turnwise.operators.metrics import STAGES, comparison, comparison_text, extract_metrics, model_averages
from turnwise.sources.results import find_latest_results

CRLF = "\r\n"
# quotes doubled, empty strings and blanks written as they are
CSV = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

# --- fixed values: wording of the Markdown report ----------------------------------------------
GENERATED = "生成时间: "
MODELS = ["", "## 模型对比", "", "| 模型 | 描述 |", "|------|------|"]
RESULTS = [
    "", "## 评估结果", "",
    "| Benchmark | Base (%) | SFT (%) | DPO (%) | SFT vs Base | DPO vs SFT |",
    "|-----------|----------|---------|---------|-------------|------------|",
]
AVERAGES = ["", "## 平均性能", ""]
AVERAGE_LINE = "- **{stage} 平均**: "
GAIN_LINE = "- {after} 相对 {before} 提升: "
CONCLUSION = ["", "## 结论", "", "[请根据实际结果填写结论和分析]"]
# ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ReportHeading:
    """Title, and one line of description per stage."""

    title: str
    descriptions: Mapping[str, str]


def _label(stage: str) -> str:
    return stage.upper() if stage != "base" else "Base"


def collect_metrics(spark: SparkSession, model_dirs: Mapping[str, str]) -> DataFrame:
    """``(model, task, value)`` from the newest result file of each model."""
    return extract_metrics(find_latest_results(spark, model_dirs))


def _fixed(spark: SparkSession, section: int, lines: Sequence[str | Column]) -> DataFrame:
    """A section of given lines."""
    numbered = F.posexplode(F.array(*[F.lit(line) if isinstance(line, str) else line for line in lines]))
    return spark.range(0, 1, 1, 1).select(numbered.alias("pos", "line")).select(
        F.lit(section).alias("section"), F.format_string("%06d", "pos").alias("item"), "line"
    )


def csv_lines(compared: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Header and one line per task; no line at all when there are no tasks."""
    shown = comparison_text(compared, stages)
    body = shown.select(F.lit(1).alias("section"), F.col("task").alias("item"), F.to_csv(F.struct("*"), CSV).alias("line"))
    header = shown.limit(1).select(
        F.lit(0).alias("section"), F.lit("").alias("item"), F.lit(",".join(shown.columns)).alias("line")
    )
    return header.union(body)


def markdown_lines(
    spark: SparkSession, metrics: DataFrame, heading: ReportHeading, now: Column, stages: Sequence[str] = STAGES
) -> DataFrame:
    """Title, models, results by task, averages, and the gains between stages that both have an average above 0."""
    shown = comparison_text(comparison(metrics, stages), stages)
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c), F.lit("")) for c in shown.columns]), F.lit(" |"))
    table = shown.select(F.lit(3).alias("section"), F.col("task").alias("item"), cells.alias("line"))

    averages = model_averages(metrics, stages)
    wide = averages.agg(*[F.max(F.when(F.col("model") == s, F.col("average"))).alias(s) for s in stages])
    lines = [
        F.concat(F.lit(AVERAGE_LINE.format(stage=_label(s))), fixed(F.col(s) * 100, 2), F.lit("%")) for s in stages
    ]
    lines.append(F.lit(""))
    for a, b in zip(stages, stages[1:]):
        gain = F.concat(F.lit("**"), gain_text((F.col(b) - F.col(a)) * 100), F.lit("**"))
        shown_gain = F.concat(F.lit(GAIN_LINE.format(after=_label(b), before=_label(a))), gain)
        lines.append(F.when((F.col(a) > 0) & (F.col(b) > 0), shown_gain))
    numbered = F.posexplode(F.array(*lines)).alias("pos", "line")
    gains = (
        wide.select(numbered)
        .filter(F.col("line").isNotNull())
        .select(F.lit(5).alias("section"), F.format_string("%06d", "pos").alias("item"), "line")
    )
    models = [f"| {_label(s)} | {heading.descriptions.get(s, '')} |" for s in stages]
    return (
        _fixed(spark, 0, [f"# {heading.title}", "", F.concat(F.lit(GENERATED), run_timestamp(now))])
        .union(_fixed(spark, 1, MODELS + models))
        .union(_fixed(spark, 2, RESULTS))
        .union(table)
        .union(_fixed(spark, 4, AVERAGES))
        .union(gains)
        .union(_fixed(spark, 6, CONCLUSION))
    )


def json_lines(
    spark: SparkSession, metrics: DataFrame, now: Column, stages: Sequence[str] = STAGES
) -> DataFrame:
    """One JSON object, two spaces of indent: the timestamp and a ``task -> value`` map per stage; no value is null."""
    is_last = F.lead("task").over(Window.partitionBy("model").orderBy("task")).isNull()
    quoted = F.substring(F.to_json(F.array("task")), F.lit(2), F.length(F.to_json(F.array("task"))) - 2)
    number = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("model"))
    entries = (
        metrics.withColumn("last", is_last)
        .withColumn("stage_no", number)
        .filter(F.col("stage_no") > 0)
        .select(
            (F.col("stage_no") * 3).cast("int").alias("section"),
            F.col("task").alias("item"),
            F.concat(
                F.lit("    "), quoted, F.lit(": "), F.coalesce(F.col("value").cast("string"), F.lit("null")),
                F.when(F.col("last"), F.lit("")).otherwise(F.lit(",")),
            ).alias("line"),
        )
    )
    stamp = F.concat(F.lit('  "timestamp": "'), iso_timestamp(now), F.lit('",'))
    frame = _fixed(spark, 0, ["{", stamp])
    for i, s in enumerate(stages, start=1):
        close = "  }" if i == len(stages) else "  },"
        frame = frame.union(_fixed(spark, i * 3 - 1, [f'  "{s}": {{'])).union(_fixed(spark, i * 3 + 1, [close]))
    return frame.union(entries).union(_fixed(spark, len(stages) * 3 + 2, ["}"]))


def write_lines(lines: DataFrame, path: str, line_sep: str = "\n") -> bool:
    """Writes the lines in order; nothing is written for an empty table."""
    if lines.isEmpty():
        return False
    lines.orderBy("section", "item").select("line").write.mode("overwrite").option("lineSep", line_sep).text(path)
    return True


def write_report(
    spark: SparkSession,
    model_dirs: Mapping[str, str],
    out: str,
    heading: ReportHeading,
    now: Column | None = None,
    stages: Sequence[str] = STAGES,
) -> DataFrame:
    """The whole analysis: comparison.csv, evaluation_report.md and metrics.json below ``out``; returns the comparison."""
    now = F.current_timestamp() if now is None else now
    # a few rows per benchmark, used by three documents: kept so that the result files are read once
    metrics = collect_metrics(spark, model_dirs).cache()
    try:
        compared = comparison(metrics, stages)
        write_lines(csv_lines(compared, stages), f"{out}/comparison.csv", CRLF)
        write_lines(markdown_lines(spark, metrics, heading, now, stages), f"{out}/evaluation_report.md")
        write_lines(json_lines(spark, metrics, now, stages), f"{out}/metrics.json")
    finally:
        metrics.unpersist()
    return compared
