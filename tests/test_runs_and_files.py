import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import arms, eventlog, panel, runs, splits
from tidemark.plans.panel import full_panel
from tidemark.sources import files
from tidemark.sources.staging import once
from tidemark.streaming import live


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_prices_take_the_ticker_of_their_file(spark, tmp_path):
    day = dt.date(2024, 1, 2)
    frame(spark, [(day, 1.0)], "session_date date, close double").write.parquet(f"{tmp_path}/AAA.parquet")
    frame(spark, [(day, 2.0, "BBB")], "session_date date, close double, ticker string").write.parquet(f"{tmp_path}/other.parquet")
    assert sorted((r.ticker, r.close) for r in files.read_prices(spark, str(tmp_path)).collect()) == [("AAA", 1.0), ("BBB", 2.0)]
    with pytest.raises(FileNotFoundError):
        files.read_prices(spark, f"{tmp_path}/none")


def test_stored_news_and_labels(spark, tmp_path):
    frame(spark, [("A", "u"), ("B", "u"), ("A", "v")], "ticker string, url string").write.parquet(f"{tmp_path}/l.parquet")
    frame(spark, [("u", "1", "old"), ("u", "2", "new")], "url string, published_at string, title string").write.parquet(f"{tmp_path}/a.parquet")
    assert sorted((r.ticker, r.title) for r in files.read_news(spark, f"{tmp_path}/l.parquet", f"{tmp_path}/a.parquet").collect()) == [("A", "new"), ("B", "new")]
    with pytest.raises(FileNotFoundError):
        files.read_news(spark, f"{tmp_path}/l.parquet", f"{tmp_path}/x.parquet")
    (tmp_path / "own.csv").write_text('title,label,annotation_source\n" a, ""b""\nc ",NEUTRAL,x\n,POSITIVE,x\nd, ,x\n')
    assert [(r.title, r.label) for r in files.read_labels(spark, f"{tmp_path}/own.csv").collect()] == [('a, "b"\nc', "NEUTRAL")]
    (tmp_path / "raw.csv").write_text("title,label,annotation_source\na,NEUTRAL,assistant_prelabel\n")
    with pytest.raises(ValueError):
        files.read_labels(spark, f"{tmp_path}/raw.csv")
    assert files.read_labels(spark, f"{tmp_path}/raw.csv", allow_preliminary=True).count() == 1


def test_a_table_is_replaced_by_one_made_of_itself(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.replace(spark.range(3), path)
    files.replace(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and len(list(tmp_path.iterdir())) == 1


def test_runs_are_found_listed_and_read(spark, tmp_path):
    record = frame(spark, [(10, {"target_mode": "excess", "horizon": "5"}, {"date_start": "2020"}, {"path": "p", "hash": "h"}, float("nan"))], "panel_rows long, config map<string,string>, provenance map<string,string>, news map<string,string>, x double")
    runs.write_run(f"{tmp_path}/one", record, {"metrics": spark.range(2)})
    (tmp_path / "none").mkdir()
    assert files.folders_with(spark, str(tmp_path), "forecast_results.json") == ["one"]
    row = runs.list_runs(spark, str(tmp_path)).first()
    assert (row.name, row.panel_rows, row.mode, row.target_mode, row.horizon) == ("one", 10, "real", "excess", 5)
    assert runs.run_table(spark, str(tmp_path), "one", "metrics").count() == 2
    for name in ("none", "../one"):
        with pytest.raises(KeyError):
            files.run_folder(spark, str(tmp_path), name)
    assert '"x":null' in runs.json_rows(record).first().value


def test_old_keys_get_their_new_names(spark):
    rows = frame(spark, [({"path": "a", "source_path": "b", "mode": "neutral"},), ({"path": "a", "hash": "h"},), ({},)], "m map<string,string>")
    found = [r.n for r in rows.select(runs.news_provenance(F.col("m")).alias("n")).collect()]
    assert found == [{"source_path": "b", "mode": "neutral"}, {"source_path": "a", "source_hash": "h", "mode": "real"}, {}]


def test_runs_that_do_not_pair_raise(spark):
    names = "arm string, window int, seed int, ticker string, target_date date, y_true string, y_pred string, has_news int"
    day = dt.date(2024, 1, 2)
    real = frame(spark, [("p", 0, 1, t, day, "UP", "UP", 1) for t in "AB"], names)
    assert runs.require_paired(real, real, "p", ("y_pred",))[0].count() == 2
    for other in (real.where("ticker = 'A'"), real.withColumn("y_pred", F.lit("DOWN")), real.unionByName(real), real.where("arm = 'x'")):
        with pytest.raises(ValueError):
            runs.require_paired(real, other, "p", ("y_pred",))
    runs.require_same_settings({"prices": 1, "note": 1}, {"prices": 1}, ("prices",))
    with pytest.raises(ValueError):
        runs.require_same_settings({"prices": 1}, {"prices": 2}, ("prices",))


def test_scalars():
    assert [runs.warmup_steps(*x) for x in ((10, 4, 1.0, 0.5), (10, 4, 2.5, 1.0), (1, 8, 0.1, 0.5))] == [2, 8, 0]
    with pytest.raises(ValueError):
        runs.warmup_steps(0, 1, 1, 0.1)
    defaults = {"how": "head", "length": 256}
    assert runs.inference_settings('{"config": {"length": 128}}', defaults, how=None) == {"how": "head", "length": 128}
    assert runs.inference_settings("torn", defaults, length=64) == {"how": "head", "length": 64}
    reference = {"size": 3, "variant": "title", "fold_results": [1], "aggregate": {"f1": 1}}
    runs.require_reference(reference, {"variant": "title", "size": 2}, ("size",))
    with pytest.raises(ValueError):
        runs.require_reference(reference, {"size": 2})


def test_an_arm_is_frozen_read_back_and_issued_once(spark, tiny, tmp_path):
    own = full_panel(spark, tiny)
    manifest = arms.refit(own, ["ret_1d", "roll_vol_5"], 30, f"{tmp_path}/arm")
    assert manifest["penalty"] in arms.PENALTIES and manifest["thresholds"][0] < manifest["thresholds"][1]
    made = arms.predict_latest(own, f"{tmp_path}/arm")
    rows = made.collect()
    last = {r.ticker: r.d for r in own.groupBy("ticker").agg(F.max("observation_date").alias("d")).collect()}
    assert rows and all(r.observation_date == last[r.ticker] and abs(r.prob_down + r.prob_flat + r.prob_up - 1) < 1e-9 and r.threshold_low == manifest["thresholds"][0] for r in rows)
    log = frame(spark, [(4, "old")], "id long, key string")
    outcome, events = arms.daily_job(own, f"{tmp_path}/arm", f"{tmp_path}/live", log)
    assert outcome == "written" and [r.id for r in events.collect()] == [5]
    assert arms.daily_job(own, f"{tmp_path}/arm", f"{tmp_path}/live", log)[0] == "unchanged"
    assert files.folders_with(spark, f"{tmp_path}/live", "latest.parquet") == ["logreg_price"]
    path = spark.read.parquet(f"{tmp_path}/live/logreg_price/predictions_*.parquet").select(*files.dated_identity(F.col("_metadata.file_path"))).first()
    assert path.arm == "logreg_price" and path.observation_date == max(last.values())
    with pytest.raises(FileNotFoundError):
        arms.load(spark, f"{tmp_path}/none")


def test_a_torn_line_is_no_event(spark, tmp_path):
    line = '{"id": %d, "ts": "t", "type": "job.status", "key": "k%d", "data": "{}"}'
    (tmp_path / "log").write_text("\n".join([line % (1, 1), "broken", line % (2, 2), line % (3, 3)]))
    assert sorted(r.id for r in eventlog.read_log(spark, f"{tmp_path}/log").collect()) == [1, 2]
    log = lambda *keys: frame(spark, [(i + 1, k) for i, k in enumerate(keys)], "id long, key string")
    kinds = [tuple(eventlog.tail_state(a, b).first()) for a, b in ((log("a", "b"), log("a", "b", "c")), (log("a", "b"), log("a", "x", "c")), (log("a", "b"), log("a")), (log(), log("a")))]
    assert kinds == [("append", 3), ("log_replaced", 3), ("log_replaced", 1), ("append", 1)]


def test_listing_walks_know_whether_they_came_to_the_end(spark):
    def page(ticker, n, status, links, declared=None, redirect=None):
        return (ticker, 2024, n, status, redirect, declared, [(u, "01/01/2024") for u in links])

    pages = [page("END", 1, 200, "ab", 9), page("END", 2, 200, "ab"), page("LAST", 1, 200, "a", 2), page("LAST", 2, 200, "b", 2), page("LAST", 3, 200, "z", 2)]
    pages += [page("FAIL", 1, 200, "a", 3), page("FAIL", 2, None, ""), page("OPEN", 1, 200, "a", 3), page("AWAY", 1, 200, "a", 1), page("PAST", 1, 200, "a"), page("PAST", 2, 302, "", None, "/Error/Index")]
    links, walks = eventlog.walked(frame(spark, pages, "ticker string, year int, page int, status int, redirect string, declared int, links array<struct<url:string,list_date:string>>"))
    assert {r.ticker: r.complete for r in walks.collect()} == {"END": True, "LAST": True, "FAIL": False, "OPEN": False, "AWAY": True, "PAST": False}
    assert sorted((r.ticker, r.url) for r in links.where("ticker in ('LAST', 'FAIL')").collect()) == [("FAIL", "a"), ("LAST", "a"), ("LAST", "b")]


def test_ewm_forgets_nothing(spark, monkeypatch):
    rows = frame(spark, [("A", k, 1000.0 if k == 0 else 0.0) for k in range(200)] + [("B", 0, None), ("B", 1, 2.0), ("B", 2, None), ("B", 3, 4.0)], "ticker string, observation_date int, x double")
    for block in (7, 256):
        monkeypatch.setattr(panel, "EWM_BLOCK", block)
        found = {(r.ticker, r.observation_date): r.y for r in panel.ewm(rows, "x", 200, "y").collect()}
        assert found["A", 128] == pytest.approx(1000 * (1 - 2 / 201) ** 128) and found["A", 199] == pytest.approx(1000 * (1 - 2 / 201) ** 199)
        assert [found["B", k] for k in (0, 1, 2)] == [None, 2.0, 2.0] and found["B", 3] == pytest.approx(2 * (199 / 201) + 4 * 2 / 201)


def test_a_shared_relation_is_made_anew_for_new_files(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    spark.range(3).write.parquet(path)
    made = lambda: once(spark, "test", [path], lambda: spark.read.parquet(path)).count()
    assert made() == made() == 3
    spark.range(2).write.mode("append").parquet(path)
    assert made() == 5


def test_streams_tail_the_log_align_news_and_count_windows(spark, tmp_path):
    log = [(1, dt.datetime(2024, 1, 1), "job.status", "k", "{}")]
    frame(spark, log, live.LOG).write.parquet(f"{tmp_path}/log")
    query = live.tail(spark, f"{tmp_path}/log").writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("tailed").count() == 1
    days = frame(spark, [("A", dt.date(2024, 1, 2))], "ticker string, session_date date")
    frame(spark, [("A", dt.datetime(2024, 1, 1, 16))], "ticker string, published timestamp_ntz").write.parquet(f"{tmp_path}/news")
    seen = []
    stream = spark.readStream.schema("ticker string, published timestamp_ntz").parquet(f"{tmp_path}/news")
    live.aligned_batches(stream, days, lambda rows, _: seen.extend(rows.collect()), f"{tmp_path}/c").awaitTermination()
    assert [(r.mapping_status, r.observation_date) for r in seen] == [("next_session", dt.date(2024, 1, 2))]
    events = frame(spark, [(dt.datetime(2024, 1, 1, 1, k), "x", 1.0) for k in (1, 2)], "ts timestamp, event_type string, value double")
    assert live.windowed_counts(events).first().n == 2


def test_undated_rows_only_train(spark):
    rows = frame(spark, [(k, dt.date(2024, 1, 1) + dt.timedelta(days=k) if k < 8 else None) for k in range(10)], "k int, day date")
    found = {r.k: r.split for r in splits.dated_or_train(rows, splits.chronological_split(rows, 0.2, 0.2, "day"), "day").collect()}
    assert found[8] == found[9] == found[0] == "train" and found[7] == "test" and found[5] == "val"
    with pytest.raises(ValueError):
        splits.text_split(frame(spark, [("never",)], "published_at string"))
    with pytest.raises(ValueError):
        splits.stratum_folds(frame(spark, [(1, "a", "x")], "id int, label string, stratum string"), 2, "label", "id", ("eval_random",))
