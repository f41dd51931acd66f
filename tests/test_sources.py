"""The same rows come back from every format; files with quirks are read as said."""

import datetime as dt
from dataclasses import replace

import pytest

from plumbline import cli
from plumbline.sources import readers
from plumbline.sources.profiles import ProfileNotFound, get_profile, group_labels
from plumbline.sources.suricata import read_eve
from plumbline.sources.zeek import ZeekFormatError, read_header, read_zeek
from plumbline.streaming.drift_monitor import monitor


def test_csv_numbers_text_and_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" x ,y,z,w\n1,1.5,é,Infinity\n2,,b,2\n,oops,c,NaN\n", encoding="utf-8")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {" x ": "bigint", "y": "string", "z": "string", "w": "double"}
    assert [r[0] for r in df.collect()] == [1, 2, None]
    (tmp_path / "b.csv").write_bytes("x,z\n1,ataque \x96 señal\n".encode("latin-1"))
    assert readers.read_csv(spark, str(tmp_path / "b.csv")).first().z == "ataque \u2013 señal"


def test_zeek_text_and_json(spark, tmp_path):
    text = "#separator \\x09\n#unset_field\t-\n#empty_field\t(empty)\n#fields\tts\tid.orig_h\tid.orig_p\tduration\tservice\n#types\ttime\taddr\tport\tinterval\tstring\n1.5\t10.0.0.1\t80\t-\t(empty)\n2.5\t10.0.0.2\t443\t0.25\thttp\n#close\tx\n"
    (tmp_path / "conn.log").write_text(text)
    rows = read_zeek(spark, str(tmp_path / "conn.log")).collect()
    assert [tuple(r) for r in rows] == [(1.5, "10.0.0.1", "80", None, None), (2.5, "10.0.0.2", "443", 0.25, "http")]
    (tmp_path / "json.log").write_text('{"ts": 1.5, "id.orig_h": "10.0.0.1"}\n')
    assert read_zeek(spark, str(tmp_path / "json.log")).columns == ["id.orig_h", "ts"]
    with pytest.raises(ZeekFormatError):
        read_header(["#separator \\x09"])


def test_eve_is_filtered_and_flattened(spark, tmp_path):
    (tmp_path / "eve.json").write_text(
        '{"event_type": "flow", "src_ip": "a", "flow": {"pkts": 1, "deep": {"x": {"y": {"z": 2}}}}}\n{"event_type": "alert", "alert": {"signature": "s"}}\n')
    df = read_eve(spark, str(tmp_path / "eve.json"))
    assert df.columns == ["flow_deep_x_y", "flow_pkts", "src_ip"] and df.count() == 1
    with pytest.raises(ValueError, match="alert, flow"):
        read_eve(spark, str(tmp_path / "eve.json"), "dns")


def test_folder_is_united_with_its_file_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,z\nq,3\n")
    (tmp_path / "note.md").write_text("no")
    df = readers.read_dataset(spark, str(tmp_path))
    assert df.columns == ["x", "y", "__source_file", "z"] and dict(df.dtypes)["x"] == "string"
    with pytest.raises(FileNotFoundError):
        readers.read_dataset(spark, str(tmp_path / "gone.csv"))
    with pytest.raises(ValueError, match="unknown format"):
        readers.read_dataset(spark, str(tmp_path / "note.md"))


def test_roles_and_profiles(spark, tmp_path):
    assert readers.detect(["Flow ID", " Source IP", "pkts_fwd", "Label"], "src_ip") == " Source IP"
    assert readers.detect(["pkts_fwd"], "time") is None
    (tmp_path / "a.csv").write_text(" Source IP,Dst,Label\na,b,flow=From-Botnet-X\nc,d,flow=Background\n")
    data = readers.load(spark, str(tmp_path / "a.csv"), roles={"dst_ip": "Dst"})
    assert data.roles.src_ip == "Source IP" and data.declared == {"Dst"} and len(data.fingerprint) == 64
    grouped = group_labels(data.df, "Label", get_profile("ctu-13").label_groups)
    assert [r.Label for r in grouped.collect()] == ["botnet", "background"]
    with pytest.raises(ProfileNotFound):
        get_profile("nope")
    assert len(get_profile("unsw-nb15-raw").csv_columns) == 49 and len(get_profile("ugr-16").csv_columns) == 13


def test_command_line_exit_codes(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("x,y,Label,split\n" + "".join(f"{i % 5},{i % 3},{'a' if i % 5 else 'b'},{'train' if i % 2 else 'test'}\n" for i in range(60)))
    path = str(tmp_path / "a.csv")
    assert cli.main(["checks"]) == 0 and cli.main(["nope"]) == 2
    assert cli.main(["audit", path, "--checks", "dup", "--fail-on", "critical", "--out", str(tmp_path / "r")]) == 1
    assert (tmp_path / "r/report.html").exists()
    assert cli.main(["audit", path, "--checks", "validity.constant", "--fail-on", "low"]) == 0
    assert cli.main(["audit", str(tmp_path / "none.csv")]) == 2
    assert cli.main(["fix", path, "--apply", "drop_constant", "--out", str(tmp_path / "o.parquet")]) == 2
    capsys.readouterr()


def test_drift_monitor_on_a_stream(spark, tmp_path):
    reference = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS value")
    rows = [(dt.datetime(2024, 1, 1, h, m), float(m * 16 if h < 5 else m * 16 + 5000)) for h in range(10) for m in range(0, 60)]
    spark.createDataFrame(rows, "ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "in"))
    out = monitor(stream, reference, "ts", "value", "1 hour")
    run = out.writeStream.format("memory").queryName("drift").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = {r.window.start.hour: r.psi for r in spark.table("drift").collect()}
    assert len(got) == 10 and max(got[h] for h in range(5)) < 0.2 < min(got[h] for h in range(5, 10))


def test_csv_types_are_those_of_all_rows_and_cells_may_hold_line_ends(spark, tmp_path):
    (tmp_path / "late.csv").write_text("x,y\n" + "".join(f"{i},{i}\n" for i in range(12_000)) + "oops,1.5\n", encoding="utf-8")
    df = readers.read_csv(spark, str(tmp_path / "late.csv"))
    assert dict(df.dtypes) == {"x": "string", "y": "double"} and df.where("x = 'oops' AND y = 1.5").count() == 1
    (tmp_path / "lines.csv").write_text('a,b\n1,"two\nlines, and ""quotes"""\n3,four\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "lines.csv")).collect()] == [(1, 'two\nlines, and "quotes"'), (3, "four")]


def test_folders_are_found_on_any_storage_and_read_by_header(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n"), ("sub/b.csv", "x,y\n3,4\n"), ("c.csv", "y,z\n5,q\n"), ("_hidden.csv", "no\n1\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    df = readers.read_dataset(spark, f"file://{tmp_path}")
    got = sorted((r["__source_file"], r.x, r.y, r.z) for r in df.collect())
    assert got == [("a.csv", 1, 2, None), ("b.csv", 3, 4, None), ("c.csv", None, 5, "q")]


def test_csv_cells_do_not_depend_on_other_lines(spark, tmp_path):
    """A doubled quote is one quote, with or without a lone quote or odd bytes elsewhere; other files keep their splitting."""
    row = '1,"say ""hi"" now"\n'
    (tmp_path / "plain file.csv").write_text("a,b\n" + row)
    (tmp_path / "lone.csv").write_text("a,b\n" + row + '2,5" pipe\n')
    (tmp_path / "open.csv").write_text("a,b\n" + row + '3,"two\nlines"\n')
    (tmp_path / "bytes.csv").write_bytes(("a,b\n" + row).encode() + b"4,\xe9t\xe9\n")
    for name, more in (("plain file", []), ("lone", [(2, '5" pipe')]), ("open", [(3, "two\nlines")]), ("bytes", [(4, "été")])):
        assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / f"{name}.csv")).collect()] == [(1, 'say "hi" now'), *more]
    got = readers.read_dataset(spark, str(tmp_path))
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, 'say "hi" now')] * 4 + [(2, '5" pipe'), (3, "two\nlines"), (4, "été")]
    assert {r["__source_file"] for r in got.select("__source_file").collect()} >= {"lone.csv", "open.csv"}


def test_a_fingerprint_depends_on_names_and_bytes_alone(spark, tmp_path, monkeypatch):
    import hashlib

    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a b.bin").write_bytes(bytes(range(256)) * 40_000)  # leaves of 4 MB: three
    (tmp_path / "d" / "sub" / "c.bin").write_bytes(b"x")
    (tmp_path / "d" / "empty").write_bytes(b"")
    (tmp_path / "d" / "_hidden").write_bytes(b"no")
    whole = readers.fingerprint(spark, str(tmp_path / "d"))
    assert whole == readers.fingerprint(spark, f"file://{tmp_path}/d", whole_bytes=1_000) == readers.fingerprint(spark, str(tmp_path / "d"), whole_bytes=0)
    total = hashlib.sha256()
    for name in ("a b.bin", "empty", "sub/c.bin"):
        data = (tmp_path / "d" / name).read_bytes()
        leaves = "".join(hashlib.sha256(data[k : k + (4 << 20)]).hexdigest() for k in range(0, len(data), 4 << 20))
        total.update(f"{name}\n{len(data)}\n{hashlib.sha256(leaves.encode()).hexdigest() if data else ''}\n".encode())
    assert whole == total.hexdigest()
    (tmp_path / "d" / "sub" / "c.bin").write_bytes(b"y")
    assert readers.fingerprint(spark, str(tmp_path / "d")) != whole
    with pytest.raises(FileNotFoundError):
        readers.fingerprint(spark, str(tmp_path / "none"))


def test_an_audit_parses_text_once(spark, tmp_path, monkeypatch):
    """Findings are those of an audit that reads the file for every check; the file is gone before the first check runs."""
    from plumbline.plans import audit

    path = tmp_path / "a.csv"
    path.write_text("x,y,Label,split\n" + "".join(f"{i % 5},{i % 3},{'a' if i % 5 else 'b'},{'train' if i % 2 else 'test'}\n" for i in range(80)))
    data = readers.load(spark, str(path))
    told = lambda report: [(f.check_id, f.severity, f.title, f.affected_rows) for f in report.ordered()]
    wanted = ["validity", "dup", "labels.conflict", "leak"]
    plain = audit.run_audit(replace(data, config=data.config | {"parsed": False}), wanted)
    real = audit.read_once

    def once(given):
        out = real(given)
        path.rename(tmp_path / "moved")
        return out

    monkeypatch.setattr(audit, "read_once", once)
    report = audit.run_audit(data, wanted)
    assert told(report) == told(plain) and told(report) and not report.errors


def test_a_folder_of_logs_is_one_read_for_each_header(spark, tmp_path):
    head = "#separator \\x09\n#unset_field\t-\n#empty_field\t(empty)\n#open\t{k}\n#fields\tts\t{name}\n#types\ttime\tcount\n"
    for k in range(4):
        (tmp_path / f"conn {k}.log").write_text(head.format(k=k, name="n" if k < 3 else "other") + f"{k}.5\t{k}\n#close\tx\n")
    (tmp_path / "rows.json").write_text('{"ts": 9.5, "n": 7}\n')
    for k in range(2):
        (tmp_path / f"eve{k}.json").write_text(f'{{"event_type": "flow", "src_ip": "h{k}", "flow": {{"pkts": {k}}}}}\n{{"event_type": "alert"}}\n')
    frames = readers.read_logs(spark, readers.files_below(spark, str(tmp_path)), "flow")
    assert len(frames) == 4  # two headers, rows, events
    got = sorted((r["__source_file"], r.ts, r.n, r.other, r.src_ip, r.flow_pkts) for r in readers.read_dataset(spark, str(tmp_path)).collect())
    want = [(f"conn {k}.log", k + 0.5, k if k < 3 else None, 3 if k == 3 else None, None, None) for k in range(4)]
    want += [(f"eve{k}.json", None, None, None, f"h{k}", k) for k in range(2)] + [("rows.json", 9.5, 7, None, None, None)]
    assert got == sorted(want)
