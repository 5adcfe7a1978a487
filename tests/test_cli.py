import numpy as np

from bitlark import cli
from bitlark.sources.store import Index
from tests.test_store import muts


def test_commands(spark, tmp_path, capsys):
    root = ["--root", str(tmp_path / "i")]
    assert cli.main([*root, "create", "--dims", "64"], spark) == 0
    Index.open(spark, str(tmp_path / "i")).apply(muts(spark, [("put", 1, [3], [7]), ("put", 2, [1], None)]))
    capsys.readouterr()
    assert cli.main([*root, "search", "3", "--metric", "jaccard"], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["1 1 1.0 2 2", "2 2 0.5 1 1"]
    assert cli.main([*root, "count", "--term", "7"], spark) == 0 and capsys.readouterr().out == "1\n"
    assert cli.main([*root, "explain", "3"], spark) == 0 and "query_bits 2" in capsys.readouterr().out
    for command in (["describe"], ["refresh-stats"], ["compact"], ["acknowledge", "2"]):
        assert cli.main([*root, *command], spark) == 0
    assert cli.main([*root, "search", "zz"], spark) == 1
    x = np.random.default_rng(0).normal(size=(64, 6)).astype("<f4")
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.f32").write_bytes(x.tobytes())
    assert cli.main(["fit", "--input", str(tmp_path / "v"), "--dims", "6", "--output", str(tmp_path / "m")], spark) == 0
    assert cli.main(["--root", str(tmp_path / "r"), "create", "--model", str(tmp_path / "m")], spark) == 0
    assert cli.main(["--root", str(tmp_path / "r"), "search-vector", "1,2,3,4,5,6", "--model", str(tmp_path / "m")], spark) == 0
