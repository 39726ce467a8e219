"""The chunked reader of column-oriented JSON."""

import io
import json
import random
import tracemalloc

import pytest

from traitgrid import storage
from traitgrid.session import CLEANUP, scratch_folder
from traitgrid.sinks import writers
from traitgrid.sinks.writers import write_columns_json, write_response_files
from traitgrid.sources import column_files
from traitgrid.sources.columns_json import json_columns, read_columns_json, read_result_tree, read_score_cards

ODD = ["a", '"', "\\", ",", "{", "}", ":", "é", "\n", " ", "[", "]", '\\"', "1"]


def _as_text(v):
    return v if v is None or isinstance(v, str) else json.dumps(v)


@pytest.mark.parametrize("seed", range(60))
def test_any_file_in_any_chunks(seed):
    rng = random.Random(seed)

    def word(n):
        return "".join(rng.choice(ODD) for _ in range(rng.randint(0, n)))
    keys = [str(i) if rng.random() < 0.8 else word(4) + str(i) for i in range(rng.randint(0, 30))]
    values = [lambda: None, lambda: True, lambda: rng.randint(-5, 10**20), rng.random, lambda: word(12)]
    cols = {f"c{j}{word(2)}": {k: rng.choice(values)() for k in keys if seed % 3 or rng.random() < 0.9} for j in range(rng.randint(0, 5))}
    raw = json.dumps(cols, ensure_ascii=seed % 2 == 0, separators=rng.choice([(",", ":"), (" , ", " : ")]), indent=rng.choice([None, 2])).encode()
    names = [*cols, "missing"]
    want = {}
    for i, c in enumerate(names):
        for k, v in cols.get(c, {}).items():
            want.setdefault(k, [None] * len(names))[i] = _as_text(v)
    for chunk in (7, 16, 50, 1 << 20):
        for held in (200, 1 << 20):
            got = {}
            for ks, vs in column_files.rows(io.BytesIO(raw), len(raw), names, chunk, held):
                for r, k in enumerate(ks):
                    assert k not in got
                    got[k] = [v[r] for v in vs]
            assert got == want


@pytest.mark.parametrize("bad", ["", "[]", '{"a":1}', '{"a":{"b":{}}}', '{"a":{"b":1}', 'x{"a":{}}', '{"a":{}} x', "not json", '{"a":{"1":[1]}}', '{"a":{"1":"x}}'])
def test_other_json_is_refused(bad):
    with pytest.raises(ValueError):
        list(column_files.rows(io.BytesIO(bad.encode()), len(bad), ["a"]))


def test_a_file_larger_than_what_the_reader_holds(tmp_path):
    path, n = str(tmp_path / "large.json"), 200_000
    with open(path, "w") as f:
        for i, c in enumerate(("question", "responses", "Openness")):
            f.write("{" if not i else ",")
            f.write(json.dumps(c) + ":{" + ",".join(f'"{r}":"{c} {r} with some text, to \\"fill\\" it"' for r in range(n)) + "}")
        f.write("}")
    size = (tmp_path / "large.json").stat().st_size
    tracemalloc.start()
    with column_files.opened(f"file:{path}") as f:
        seen = sum(len(keys) for keys, _ in column_files.rows(f, size, ["question", "responses", "Openness"], chunk=1 << 16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and size > 32 << 20 and peak < 8 << 20  # chunks of each column, not the file


def test_stores_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text('{"a":{"0":"x"}}')
    monkeypatch.setattr("traitgrid.sources.columns_json._reachable", lambda path: False)
    assert read_columns_json(spark, str(tmp_path), {"a": "string"}).select("a").first()[0] == "x"


def test_cards_with_unlike_columns_are_united(spark, tmp_path):
    (tmp_path / "a__20250101_120000.json").write_text('{"Honesty":{"0":"4.0+-0.5"},"N\\/A":{"0":0.0}}')
    (tmp_path / "b__20250101_120001.json").write_text('{"Openness":{"0":"3.0+-0.1"},"Wit":{"0":"2.0+-0.2"},"N\\/A":{"0":0.5}}')
    assert json_columns(spark, str(tmp_path)) == ["Honesty", "N/A", "Openness", "Wit"]
    got = {r.file_name[0]: r for r in read_score_cards(spark, str(tmp_path)).collect()}
    assert (got["a"].Honesty, got["a"].Openness, got["b"].Honesty, got["b"].Openness, got["b"].Wit, got["b"].na_share) == ("4.0+-0.5", None, None, "3.0+-0.1", "2.0+-0.2", 0.5)
    assert "Wit" not in read_score_cards(spark, str(tmp_path), ["Openness"]).columns


def _cells(spark, n=2500):
    from pyspark.sql import functions as F

    return spark.range(n).select(F.lit("gpt 4/o").alias("model"), F.when(F.col("id") < 2000, "Openness").otherwise("A b%c").alias("trait"), F.lit(3).alias("value"),
                                 (F.col("id") * 7919 % 100_003).alias("item_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit('say "5", {x}\\\n'), F.col("id").cast("string"))).alias("responses"),
                                 F.when(F.col("id") % 2 == 0, "4").otherwise("N/A").alias("numbers_extracted"), (F.col("id") / 8).alias("elapsed_times"))


def test_files_under_their_real_names(spark, tmp_path):
    df, root = _cells(spark), str(tmp_path / "tree")
    paths = write_response_files(df, root, rows_per_file=900)
    assert sorted(p.split("/tree/")[1] for p in paths) == ["gpt 4/o/A b%c_3.json", "gpt 4/o/Openness_3.1.json", "gpt 4/o/Openness_3.2.json", "gpt 4/o/Openness_3.json"]
    sizes = sorted(len(json.load(open(p))["responses"]) for p in paths)
    assert sizes == [200, 500, 900, 900] and storage.names(spark, root) == ["gpt 4"]
    one = json.load(open(f"{root}/gpt 4/o/Openness_3.json"))
    assert list(one) == ["responses", "numbers_extracted", "elapsed_times"] and list(map(int, one["responses"])) == sorted(map(int, one["responses"]))
    back = read_result_tree(spark, root, ["Openness"]).select("item_id", "response_text", "rating_text", "elapsed_s")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.select("item_id", "responses", "numbers_extracted", "elapsed_times").collect()))


def test_the_reader_agrees_with_pandas(spark, tmp_path):
    import pandas as pd

    write_response_files(_cells(spark, 50).withColumnRenamed("responses", "r"), str(tmp_path))
    pdf = pd.read_json(str(tmp_path / "gpt 4" / "o" / "Openness_3.json"))
    assert len(pdf) == 50 and list(pdf.columns) == ["r", "numbers_extracted", "elapsed_times"]


def test_chunked_folders_keep_the_row_limit(spark, tmp_path):
    path = str(tmp_path / "out")
    write_columns_json(_cells(spark), path, "item_id", rows_per_file=100, chunk_cols=["trait", "value"])
    found = read_columns_json(spark, path, {"responses": "string"}, "item_id")
    counts = sorted(r["count"] for r in found.groupBy("file_path").count().collect())
    assert counts == [100] * 25 and {r.trait for r in found.select("trait").distinct().collect()} == {"Openness", "A b%c"}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    df = _cells(spark).withColumn("responses", F.when(F.col("item_id") == 7919, F.raise_error("broken").cast("string")).otherwise(F.col("responses")))
    with pytest.raises(Exception, match="broken"):
        write_response_files(df, str(tmp_path / "tree"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_columns_looked_up_beside_do_not_go_through_the_shuffle(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    df = _cells(spark, 300).withColumn("key", F.col("item_id") % 7)
    items = spark.range(6).select(F.col("id").alias("key"), F.concat(F.lit("I am "), F.col("id").cast("string")).alias("question"), F.lit(float("inf")).alias("Openness"))
    cols, dealt = ["question", "Openness", "responses"], []
    write_response_files(df.join(items, "key"), str(tmp_path / "a"), columns=cols)
    monkeypatch.setattr(type(df), "repartition", lambda self, *a, f=type(df).repartition: dealt.append(self.columns) or f(self, *a))
    write_response_files(df, str(tmp_path / "b"), columns=cols, beside=items, on="key")
    assert dealt == [["model", "__file", "__order", "responses", "key"]]
    a, b = (json.load(open(tmp_path / x / "gpt 4" / "o" / "Openness_3.json")) for x in "ab")
    assert a == b and list(a) == cols and 0 < len(a["question"]) < 300 and set(a["Openness"].values()) == {None}


def _in_waves(monkeypatch, rows=400):
    monkeypatch.setattr(writers, "WAVE_ROWS", rows)
    monkeypatch.setattr(writers, "parallelism", lambda spark: 1)


def _all_files(path):
    return {str(p.relative_to(path)): [(c, list(v.items())) for c, v in json.loads(p.read_text()).items()] for p in path.rglob("*.json")}


def test_rows_go_to_their_files_in_waves(spark, tmp_path, monkeypatch):
    """Many rows are dealt and sorted some files at a time; the files are those of one turn."""
    from pyspark.sql import functions as F

    df = _cells(spark, 1200).withColumns({"value": F.col("item_id") % 9, "model": F.when(F.col("item_id") % 11 > 0, F.col("model")), "key": F.col("item_id") % 7, "none": F.lit(None), "day": F.make_dt_interval(F.lit(1))})
    items = spark.range(6).select(F.col("id").alias("key"), F.concat(F.lit("I am "), F.col("id").cast("string")).alias("question"), F.lit(float("inf")).alias("Openness"))
    cols = ["question", "Openness", "responses", "elapsed_times", "none", "day"]

    def write(at):
        write_response_files(df, str(tmp_path / at / "a"), rows_per_file=100, columns=cols, beside=items, on="key")
        write_columns_json(df, str(tmp_path / at / "b"), "item_id", rows_per_file=60, chunk_cols=["model", "value"])

    write("once")
    sizes, once = [], writers._write_lines
    monkeypatch.setattr(writers, "_write_lines", lambda rows, *a: sizes.append(rows.count()) or once(rows, *a))
    _in_waves(monkeypatch)
    write("waves")
    assert len(sizes) == 6 and max(sizes) < 800 and sum(sizes) == 2 * 1200
    a, b = _all_files(tmp_path / "once"), _all_files(tmp_path / "waves")
    assert a == b and len(a) > 50


def test_nothing_is_left_beside_the_files(spark, tmp_path, monkeypatch):
    """Sizes, numbers and stored rows go with the write, also with one that fails."""
    from pyspark.sql import functions as F

    folder, before = scratch_folder(spark).removeprefix("file:"), None
    for waves in (False, True):
        if waves:
            _in_waves(monkeypatch)
        before = sorted(storage.names(spark, folder))
        write_response_files(_cells(spark), str(tmp_path / f"tree{waves}"), rows_per_file=90)
        bad = _cells(spark).withColumn("responses", F.when(F.col("item_id") == 7919, F.raise_error("broken").cast("string")).otherwise(F.col("responses")))
        with pytest.raises(Exception, match="broken"):
            write_response_files(bad, str(tmp_path / f"bad{waves}"), rows_per_file=90)
        assert sorted(storage.names(spark, folder)) == before and not _all_files(tmp_path / f"bad{waves}")
        assert spark.conf.get(CLEANUP, "false") == "false"
