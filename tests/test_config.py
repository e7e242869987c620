import json

import pytest

from fathomline.sources import config

GOOD = {"connections": [{"name": "Local", "url": "jdbc:x://${HOST}", "user": "me", "password": "${WORD}", "query_timeout": 9, "databases": [{"name": "Port", "schemas": ["deck", "hull"]}]}], "scan": {"lineage": False}}


def put(folder, raw, name="c.json"):
    (folder / name).write_text(raw if isinstance(raw, str) else json.dumps(raw))
    return folder / name


def test_a_file_and_its_environment(tmp_path, monkeypatch):
    monkeypatch.setenv("HOST", "sea")
    (tmp_path / ".env").write_text("# said\nexport WORD = 'a=b'\nHOST=land\nnothing\n")
    found = config.load(put(tmp_path, GOOD))
    c = found.connection("LOCAL")
    assert c.url == "jdbc:x://sea" and c.properties() == {"user": "me", "password": "a=b", "queryTimeout": "9", "fetchsize": "10000"} and "a=b" not in repr(c)
    assert c.selected() == [("Port", "deck"), ("Port", "hull")] and found.options == config.Options(lineage=False) and found.store == str(tmp_path / "snapshots")
    toml = 'store = "s3://x"\n[[connections]]\nname = "A"\nurl = "u"\n[[connections.databases]]\nname = "d"\nschemas = ["s"]\n'
    assert config.load(put(tmp_path, toml, "c.toml")).store == "s3://x"
    with pytest.raises(config.ConfigError, match="there are: Local"):
        found.connection("far")


def changed(**parts):
    return {"connections": [{k: v for k, v in (GOOD["connections"][0] | parts).items() if v is not None}]}


@pytest.mark.parametrize(
    "raw",
    [
        "{", "[]", {}, {"connections": []}, {"connections": [1]}, changed(name=None), changed(url=""), changed(databases=[]), changed(databases=[{"name": "Port", "schemas": []}]), changed(password=None),
        changed(query_timeout=0), changed(query_timeout=True), changed(fetch_size=1_000_001), changed(url="${ABSENT}"), {"connections": GOOD["connections"] * 2}, GOOD | {"scan": {"lineage": 1}}, GOOD | {"scan": {"other": True}},
    ],
)
def test_faults(tmp_path, raw):
    with pytest.raises(config.ConfigError):
        config.load(put(tmp_path, raw), {"HOST": "h", "WORD": "w"})


def test_no_file(tmp_path):
    for name in ("none.json", "c.ini"):
        with pytest.raises(config.ConfigError):
            config.load(tmp_path / name)
