"""The command line."""

from veilspark.__main__ import default_output, main


def test_process_and_detect(spark, capsys, tmp_path, monkeypatch):
    assert main(["process", "почта", "a@b.ru"], spark) == 0
    out = capsys.readouterr().out
    assert "anonymized_text: почта <EMAIL_" in out and "llm_response: почта a@b.ru" in out
    (tmp_path / "a.txt").write_text("a@b.ru")
    assert main(["detect", str(tmp_path)], spark) == 0 and "EMAIL" in capsys.readouterr().out


def test_evaluation(spark, capsys, tmp_path):
    from veilspark.sources.files import EXAMPLE_SCHEMA

    spark.createDataFrame([("1", "d", "почта a@b.ru", [(6, 12, "EMAIL")]), ("2", "d", "Иван", [(0, 4, "NAME")])], EXAMPLE_SCHEMA).write.parquet(str(tmp_path / "ex"))
    a, b, c = (str(tmp_path / n) for n in ("a.json", "b.json", "c.json"))
    assert main(["run", str(tmp_path / "ex"), "--output", a, "--misses", str(tmp_path / "misses")], spark) == 0
    assert main(["run", str(tmp_path / "ex"), "--output", b, "--min-confidence", "1.0"], spark) == 0
    assert main(["run", str(tmp_path / "ex"), "--output", c, "--config", "other"], spark) == 0
    assert spark.read.json(str(tmp_path / "misses")).select("id").first()[0] == "2"
    assert main(["show", a], spark) == 0
    capsys.readouterr()
    assert main(["compare", a, b], spark) == 0
    out = capsys.readouterr().out
    assert "warning: min_confidence" in out and "worse" in out
    assert main(["compare", a, c], spark) == 2
    assert main(["run", str(tmp_path / "ex"), "--output", b, "--min-confidence", "2"], spark) == 2
    assert default_output("x", "1.0", "0123456789abc", "d").name == "1.0-0123456789-d.json"
