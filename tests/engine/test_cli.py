import json

from sawmill.__main__ import run


def test_commands(spark, tmp_path):
    root = str(tmp_path / "root")
    (tmp_path / "a.log").write_text("".join(f"2024-01-01 00:00:{i:02d} user=u{i % 3} said hello {i}\n" for i in range(50)))
    do = lambda *a: run(spark, [root, *a])
    do("create", "web", "max_segments=4")
    assert "'ingested': 50" in do("ingest", "web", str(tmp_path / "a.log"))
    assert json.loads(do("query", "web", "hello | stats count")) == {"count": 50}
    assert len(json.loads(do("query", "web", "user=u1", "--pretty"))) == 17
    templates = do("templates", "web")
    assert templates.startswith("E")
    first = templates.split()[0]
    assert do("alias", "web", "add", "who", f"{first}_V0").startswith(f"who: {first}_V0")
    assert do("alias", "web", "get", "WHO").strip() == f"{first}_V0" and do("alias", "web", "find", f"{first}_V0").strip() == "who"
    assert do("alias", "web", "list") == f"who: {first}_V0\n"
    assert do("discover", "web")
    assert do("indices").split("\t")[:2] == ["web", "1"]
    assert do("retain", "web") == ""
    do("delete", "web")
    assert do("indices") == ""
