"""``python -m turnwise prepare | report | check`` (or the same through spark-submit)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from turnwise.operators.labels import MAX_SEQ_LENGTH
from turnwise.operators.metrics import STAGES, sorted_tasks
from turnwise.operators.tokens import ByteEncoder, SpecialIds, TokenizerFileEncoder
from turnwise.plans import prepare, readiness, report
from turnwise.sources.registry import INSTRUCTION_CORPORA, PREFERENCE_CORPORA


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="turnwise")
    jobs = parser.add_subparsers(dest="job", required=True)

    p = jobs.add_parser("prepare", help="format, tokenise, split and write a corpus")
    p.add_argument("--dataset", default="alpaca", choices=[*INSTRUCTION_CORPORA, *PREFERENCE_CORPORA])
    p.add_argument("--data_root", default=prepare.DATA_ROOT)
    p.add_argument("--tokenizer", help="tokenizer.json; without one, UTF-8 bytes are the ids")
    p.add_argument("--eos_id", type=int)
    p.add_argument("--output_dir", default="data/processed")
    p.add_argument("--max_seq_length", type=int, default=MAX_SEQ_LENGTH)
    p.add_argument("--validation_size", type=float, default=0.02)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--on_overflow", default="truncate", choices=["truncate", "drop"])

    r = jobs.add_parser("report", help="compare the newest evaluation results of the model stages")
    r.add_argument("--results_dir", default="eval_results")
    r.add_argument("--output", default="report")
    r.add_argument("--title", default="Evaluation report")
    r.add_argument("--describe", nargs="*", default=[], metavar="STAGE=TEXT", help="what each stage is")

    c = jobs.add_parser("check", help="are the corpora there?")
    c.add_argument("--data_root", default=prepare.DATA_ROOT)
    c.add_argument("--datasets", nargs="+", default=["alpaca", "ultrafeedback"])
    return parser.parse_args(argv)


def _prepare(spark: SparkSession, a: argparse.Namespace) -> bool:
    if a.dataset in PREFERENCE_CORPORA:
        _, stats = prepare.prepare_preference_corpus(spark, a.dataset, a.output_dir, [a.data_root])
        lost = prepare.losses(spark, a.dataset, roots=[a.data_root])
    else:
        encoder = TokenizerFileEncoder.from_file(a.tokenizer) if a.tokenizer else ByteEncoder()
        options = prepare.PrepareOptions(
            a.max_seq_length, a.validation_size, a.seed, a.on_overflow, SpecialIds(eos=a.eos_id)
        )
        _, stats = prepare.prepare_instruction_corpus(
            spark, a.dataset, encoder, a.output_dir, options, [a.data_root]
        )
        lost = prepare.losses(spark, a.dataset, encoder, options, [a.data_root])
    stats.show()
    lost.show()
    return True


def _report(spark: SparkSession, a: argparse.Namespace) -> bool:
    folders = {stage: f"{a.results_dir}/{stage}" for stage in STAGES}
    heading = report.ReportHeading(a.title, dict(d.split("=", 1) for d in a.describe))
    compared = report.write_report(spark, folders, a.output, heading)
    sorted_tasks(compared).show(truncate=False)
    return True


def _check(spark: SparkSession, a: argparse.Namespace) -> bool:
    folders = {d: f"{a.data_root}/{d}" for d in a.datasets}
    checks = readiness.readiness(spark, folders, {})
    checks.show(truncate=False)
    return readiness.all_passed(checks).first().all_passed


def main(argv: list[str] | None = None) -> int:
    arguments = _arguments(argv)
    spark = SparkSession.builder.appName(f"turnwise {arguments.job}").getOrCreate()
    run = {"prepare": _prepare, "report": _report, "check": _check}[arguments.job]
    return 0 if run(spark, arguments) else 1


if __name__ == "__main__":
    sys.exit(main())
