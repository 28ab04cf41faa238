import json

from beliefloom import cli


def test_queries_and_checks(spark, sf, capsys):
    assert cli.main([sf, "query", "CLAIMS WHERE"]) == 2
    assert cli.main([sf, "query", "CLAIMS WHERE score > 0.45"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert rows and all(r["score"] > 0.45 for r in rows)
    assert cli.main([sf, "verify"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"ok": True}
    assert cli.main([sf, "run", "no_such_query"]) == 2
    assert cli.main([sf, "run", "status_counts"]) == 0
