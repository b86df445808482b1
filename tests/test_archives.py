"""The ZIP data sources: types that change late, damaged members, pruning, and the reader for stores that only Spark reaches."""

import zipfile

import pytest

from kinetra.run import RunConfig, Store, read_recordings
from kinetra.sources import archives, zip_source

FRAMES = 60_000


def frames_text(n=FRAMES, late="0.25"):
    head = " Unnamed: 0, track_id , frame_id,timestamp_ms,agent_type,x,y,vx,vy,yaw_rad,heading_rad,length,width,ax,ay,v_lon,v_lat,a_lon,a_lat\n"
    lines = [f"{k},1,{k},{k * 100},car," + ",".join(["1"] * 14) for k in range(n)]
    return head + "\n".join(lines) + f"\n{n},1.0,{n},{n * 100}.5,car," + ",".join([late] * 14) + "\n"


def meta_text(n=120_000):
    return "trackId,class,extra,CrossType\n" + "".join(f"{k},,x,\n" for k in range(n)) + f"{n},car,x,Left turn\n"


def make(path, members, compression=zipfile.ZIP_DEFLATED):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", compression) as z:
        for name, text in members.items():
            z.writestr(name, text)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("archives")
    make(root / "deep" / "8_2_1(1).zip", {"in/" + archives.VEHICLE_MEMBER: frames_text(), archives.METADATA_MEMBER: meta_text(), "Traffic_a.csv": "x\n"})
    make(root / "xian_1.zip", {archives.VEHICLE_MEMBER: frames_text(10)})
    make(root / "unrelated_report.zip", {archives.VEHICLE_MEMBER: "x"})
    return root


def test_types_that_change_late_are_read_whole(spark, root):
    for rows in (archives.read_rows(spark, str(root), archives.VEHICLE_MEMBER, archives.FRAME_SCHEMA), archives.read_members(archives.discover_archives(spark, str(root)), archives.VEHICLE_MEMBER, archives.FRAME_SCHEMA)):
        rows = rows.cache()
        assert {(r.city, r.status, r["count"]) for r in rows.groupBy("city", "status").count().collect()} == {("Tianjin", "ok", FRAMES + 1), ("Xi'an", "ok", 11)}
        last = rows.where(f"frame_id = {FRAMES}").first()
        assert (last.track_id, last.timestamp_ms, last.a_lat, last.recording_id, last.source_archive) == (1, FRAMES * 100 + 0.5, 0.25, "8_2_1", "8_2_1(1).zip")
        rows.unpersist()


def test_metadata_that_begins_late(spark, root):
    for rows in (archives.read_rows(spark, str(root), archives.METADATA_MEMBER, archives.METADATA_SCHEMA, required=False), archives.read_metadata(archives.discover_archives(spark, str(root)))):
        assert rows.count() == 120_001
        last = rows.where("trackId = 120000").first()
        assert (last["class"], last.CrossType, last.Signal_Violation_Behavior) == ("car", "Left turn", None)


def test_only_wanted_columns_and_archives(spark, root):
    pruned = archives.read_rows(spark, str(root), archives.VEHICLE_MEMBER, "track_id long, agent_type string")
    assert pruned.columns[-2:] == ["track_id", "agent_type"] and pruned.where("city = \"Xi'an\"").count() == 11
    reader = zip_source._RowsReader(pruned.schema, {"path": str(root), "member": archives.VEHICLE_MEMBER})
    left = list(reader.pushFilters([zip_source.EqualTo(("city",), "Tianjin"), zip_source.In(("recording_id",), ("8_2_1", "x")), zip_source.EqualTo(("track_id",), 1)]))
    assert [f.attribute for f in left] == [("track_id",)] and [m.source_archive for m in reader.partitions()] == ["8_2_1(1).zip"]
    assert next(reader.read(reader.partitions()[0])).schema.names[-2:] == ["track_id", "agent_type"]
    plan = pruned.where("city = 'Tianjin'")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan archive_rows" in plan and "= Tianjin" not in plan  # the source has taken the condition


def test_damaged_archives_are_failures_of_their_own(spark, tmp_path):
    make(tmp_path / "8_1_1.zip", {archives.VEHICLE_MEMBER: frames_text(20_000, late="no number")})
    make(tmp_path / "8_1_2.zip", {archives.VEHICLE_MEMBER: frames_text(3), archives.METADATA_MEMBER: "trackId\n" + "1\n" * 200_000 + "x\n"})
    make(tmp_path / "8_1_3.zip", {"a.csv": "x"})
    make(tmp_path / "8_1_4.zip", {archives.VEHICLE_MEMBER: "a,b\n1,2\n"})
    make(tmp_path / "8_1_5.zip", {archives.VEHICLE_MEMBER: frames_text(1).split("\n")[0] + "\n", archives.METADATA_MEMBER: ""})
    make(tmp_path / "8_1_6.zip", {archives.VEHICLE_MEMBER: frames_text(50_000)}, zipfile.ZIP_STORED)
    raw = bytearray((tmp_path / "8_1_6.zip").read_bytes())
    raw[len(raw) // 2] ^= 1
    (tmp_path / "8_1_6.zip").write_bytes(bytes(raw))
    (tmp_path / "8_1_7.zip").write_bytes(b"no zip")
    for rows in (archives.read_rows(spark, f"file://{tmp_path}", archives.VEHICLE_MEMBER, archives.FRAME_SCHEMA), archives.read_members(archives.discover_archives(spark, str(tmp_path)), archives.VEHICLE_MEMBER, archives.FRAME_SCHEMA)):
        ok, failed = archives.split_failures(rows)
        errors = {r.recording_id: r.error for r in failed.collect()}
        assert sorted(errors) == ["8_1_1", "8_1_3", "8_1_4", "8_1_6", "8_1_7"]
        assert "no number" in errors["8_1_1"] and "not in the archive" in errors["8_1_3"] and "missing columns" in errors["8_1_4"]
        assert {(r.recording_id, r["count"]) for r in ok.groupBy("recording_id").count().collect()} == {("8_1_2", 4)}
    with pytest.raises(RuntimeError, match="8_1_2.zip"):
        archives.read_metadata(archives.discover_archives(spark, str(tmp_path)))
    store = Store(spark, f"file://{tmp_path}/out")
    with pytest.raises(RuntimeError, match="7 recordings failed"):
        read_recordings(store, RunConfig(), str(tmp_path))
    report = spark.read.option("header", True).csv(f"{store.root}/reports/failed_recordings").collect()
    assert ("8_1_2", archives.METADATA_MEMBER) in {(r.recording_id, r.member) for r in report}


def test_audit_checks_every_member(spark, root, tmp_path):
    for found in (archives.audit_members(spark, str(root)), archives.audit(archives.discover_archives(spark, str(root)))):
        got = {r.recording_id: (r.zip_ok, r.has_vehicle, r.has_metadata, r.has_pedestrian, r.traffic_members, r.member_count) for r in found.collect()}
        assert got == {"8_2_1": (True, True, True, False, 1, 3), "xian_1": (True, True, False, False, 0, 1)}
    (tmp_path / "xian_2.zip").write_bytes(b"no zip")
    make(tmp_path / "xian_3.zip", {})
    got = {r.recording_id: (r.zip_ok, r.has_vehicle, r.member_count) for r in archives.audit_members(spark, str(tmp_path)).collect()}
    assert got == {"xian_2": (False, False, 0), "xian_3": (True, False, 0)}


def test_stores_without_a_python_file_system(spark, root):
    assert not zip_source.is_reachable("viewfs://store/in") and zip_source.is_reachable(f"file://{root}")
    for names in (["changchun_1", "a_NR_b", "Xian_x", "1_2_3", "1_2_3\n", "x1_2_3", "report"],):
        df = archives.archive_name_rules(spark.createDataFrame([(f"{n}.zip",) for n in names], "n string"), "n")
        assert [(r.city, r.recording_id) for r in df.collect()] == [(c, s if c else None) for c, s in (zip_source.place_of(f"{n}.zip") for n in names)]
