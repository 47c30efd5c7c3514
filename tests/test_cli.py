"""The command line and its settings."""

from knotwork.__main__ import main, parser
from knotwork.config import PatternSettings


def test_settings():
    s = PatternSettings.of('inputDir = "/g" # where\ntargetGraph: youtube\ndefaultLabel=false\nlabels = ["A", "B"]\nquerySample = "Q2"\nindexDir=/i\n')
    assert s == PatternSettings("/g", "youtube", False, ["A", "B"], "q2", "/i")


def test_tools(spark, tmp_path, capsys):
    (tmp_path / "e.txt").write_text("1 2\n1 3\n2 3\n3 4\n")
    (tmp_path / "l.txt").write_text("1 A\n2 B\n3 C\n4 A\n")
    main(["--out", str(tmp_path / "core"), "k-core", str(tmp_path / "e.txt"), "--k", "2"])
    assert spark.read.parquet(str(tmp_path / "core")).count() == 3
    main(["--out", str(tmp_path / "n"), "search", str(tmp_path / "e.txt"), "--labels", str(tmp_path / "l.txt"), "--query", "q1"])
    assert spark.read.parquet(str(tmp_path / "n")).first()[0] == 1
    main(["triangle-count", str(tmp_path / "e.txt")])
    assert "triangle-count" in capsys.readouterr().out
    assert parser().parse_args(["k-truss", "x"]).k == 4
