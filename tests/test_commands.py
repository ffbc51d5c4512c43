import json

from turnwise.__main__ import main
from turnwise.operators.batched import map_batches

import recorded


def test_map_batches(spark):
    df = spark.range(0, 10, 1, 2)

    def halves(columns):
        kept = [i for i in columns["id"] if i % 2 == 0]
        return {"id": kept, "half": [[i // 2] for i in kept]}

    got = map_batches(df, halves, "id bigint, half array<int>").orderBy("id").collect()
    assert [(r.id, r.half) for r in got] == [(i, [i // 2]) for i in range(0, 10, 2)]


def test_commands(spark, tmp_path):
    raw = tmp_path / "raw"
    (raw / "alpaca").mkdir(parents=True)
    rows = [{"instruction": f"i{i}", "input": "", "output": "o"} for i in range(60)]
    (raw / "alpaca" / "alpaca_data.json").write_text(json.dumps(rows))
    out = str(tmp_path / "out")
    assert main(["prepare", "--data_root", str(raw), "--output_dir", out, "--max_seq_length", "64", "--eos_id", "256"]) == 0
    done = spark.read.parquet(f"{out}/alpaca_sft")
    assert done.count() == 60 and done.filter("split = 'validation'").count() == 2
    assert {r.input_ids[-1] for r in done.collect()} == {256}
    assert main(["check", "--data_root", str(raw), "--datasets", "alpaca"]) == 0
    assert main(["check", "--data_root", str(raw)]) == 1
    for stage, results in (("base", recorded.BASE), ("sft", recorded.SFT), ("dpo", recorded.DPO)):
        (tmp_path / "eval" / stage).mkdir(parents=True)
        (tmp_path / "eval" / stage / "results.json").write_text(json.dumps(recorded.document(results, 1.0)))
    target = ["--results_dir", str(tmp_path / "eval"), "--output", str(tmp_path / "report")]
    assert main(["report", *target, "--describe", "base=as published", "dpo=a=b"]) == 0
    assert (tmp_path / "report" / "comparison.csv" / "_SUCCESS").exists()
    lines = [r.value for r in spark.read.text(str(tmp_path / "report" / "evaluation_report.md")).collect()]
    assert "| Base | as published |" in lines and "| DPO | a=b |" in lines and "| SFT |  |" in lines
