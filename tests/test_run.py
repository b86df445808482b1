"""The run as a whole, from small archives to the evidence table."""

import json
import zipfile

import numpy as np
import pytest

from kinetra.config import ValidationConfig
from kinetra.operators import validation
from kinetra.operators.cluster import Centres
from kinetra.operators.mixture import Mixture, gaussian_mixture
from kinetra.run import RunConfig, Store, run
from kinetra.sources import archives

HEAD = "track_id,frame_id,timestamp_ms,agent_type,x,y,vx,vy,yaw_rad,heading_rad,length,width,ax,ay,v_lon,v_lat,a_lon,a_lat\n"


def make_archives(root):
    """Four kinds of tracks: steady, stop-and-go, of varying speed, and with strong acceleration."""
    rng = np.random.default_rng(1)
    for name in ("8_2_1", "8_3_1", "xian_1", "changchun_1"):
        lines, meta = [], []
        for track in range(24):
            kind, x, before = track % 4, 0.0, None
            for f in range(40):
                t = f * 0.25
                v = (8.0, 6.0 if (f // 10) % 2 else 0.1, 10.0 + 3 * np.sin(t), 4.0 + 1.5 * t)[kind] + rng.normal(0, 0.05)
                a = 0.0 if before is None else (v - before) / 0.25
                before = v
                a += (0, 0, 0, 6.0 * (f % 20 == 5))[kind]
                x += v * 0.25
                lines.append(f"{track},{f},{1000 * t},car,{x:.4f},0,{v:.4f},0,0,0,4,2,0,0,{v:.4f},0,{a:.4f},0")
            meta.append(f"{track},car,{('Left', 'Others', 'Straight')[track % 3]},{('No violation of traffic lights', 'red-light running')[track % 5 == 0]}")
        with zipfile.ZipFile(root / f"{name}.zip", "w") as z:
            z.writestr(archives.VEHICLE_MEMBER, HEAD + "\n".join(lines) + "\n")
            z.writestr(archives.METADATA_MEMBER, "trackId,class,CrossType,Signal_Violation_Behavior\n" + "\n".join(meta) + "\n")


def test_archives_to_evidence(spark, tmp_path):
    source, root = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    make_archives(source)
    config = RunConfig(validation=ValidationConfig(city_restarts=4, recording_restarts=2), ks=(4,), restarts=3, final_restarts=6, seeds=(42, 43), bootstraps=2, hopkins_repeats=1, hopkins_points=20, mixture_ks=(4,), ward_ks=(4,), ward_sample=60, density_sample=80, eps_quantiles=(0.9,), min_samples=(5,), hdbscan=((10, 5),), representatives=2)
    store = run(spark, str(source), root, config)
    assigned = store.table("assignments")
    assert assigned.count() == 96 and assigned.groupBy("profile_id").count().count() == 4
    kinds = assigned.selectExpr("track_id % 4 AS kind", "profile_id").distinct().collect()
    assert len(kinds) == 4 and {r.kind: r.profile_id for r in kinds}[1] == 2  # each kind is one profile, and the second stops
    benchmark = {r.model_family for r in store.table("model_benchmark").collect()}
    assert benchmark == {"KMeans", "MiniBatchKMeans", "GaussianMixture", "Ward", "DBSCAN", "HDBSCAN"}
    city = store.table("validation_summary").where("split_type = 'city'").first()
    assert city.splits == 3 and city.mean_ari > 0.95 and store.table("city_predictions").count() == 96
    evidence = {(r.evidence_category, r.metric): r.value for r in store.table("evidence").collect()}
    assert evidence["Coverage", "Trajectory coverage %"] == 100.0 and evidence["Association with crossing", "Cramer's V"] is not None
    cells = store.table("crossing_cells")
    assert cells.count() == 4 * 3 and cells.agg({"count": "sum"}).first()[0] == 96
    assert store.table("crossing_without_others_cells").count() == 4 * 2
    assert {r.warning for r in store.table("attention").collect()} and "focus" in store.table("attention").columns
    assert spark.read.option("header", True).csv(f"{root}/reports/evidence").count() == len(evidence)
    assert Centres.from_json(store.json("model")).inertia == pytest.approx(store.table("partition_quality").first().inertia)
    before = json.loads(store.json("done-features"))
    run(spark, str(source), root, config)  # everything is done
    assert json.loads(Store(spark, root).json("done-features")) == before


def test_key_sets_and_saved_mixtures(spark, tmp_path):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ((1, 2), (2, 3)))
    validation.require_subset(a.where("k = 2"), b, ["k"])
    validation.require_disjoint(a.where("k = 1"), b, ["k"])
    for f in (validation.require_subset, validation.require_disjoint):
        with pytest.raises(ValueError, match="1 keys"):
            f(a, b, ["k"])
    df = spark.createDataFrame([(float(i % 2 * 10 + i * 0.01),) for i in range(40)], "a double")
    model = gaussian_mixture(df, ["a"], 2)
    model.save(f"file://{tmp_path}/m")
    again = Mixture.load(f"file://{tmp_path}/m")
    assert again.bic == pytest.approx(model.bic) and again.predict(df).collect() == model.predict(df).collect()
