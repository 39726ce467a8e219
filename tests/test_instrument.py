
from traitgrid.operators.instrument import key_from_inventory, key_long, key_wide, keyed_items, parse_inventory

TEXT = ("N1: CALM (Alpha = .83)\n+ keyed\tStay calm.\n \tRelax often.\n\n"
        "– keyed\tPanic easily.\n \tWorry a lot.\n\n"
        "E2: JOY (.88)\n+ keyed\tLaugh aloud.\n\n"
        "- keyed\tFrown Often.")


def test_parse_inventory(spark):
    df = spark.createDataFrame([("f", TEXT)], "file_id string, text string")
    rows = parse_inventory(df).orderBy("item_no").collect()
    assert [(r.item_no, r.trait, r.sign, r.question) for r in rows] == [
        (0, "Neuroticism", 1, "I stay calm."), (1, "Neuroticism", 1, "I relax often."),
        (2, "Neuroticism", -1, "I panic easily."), (3, "Neuroticism", -1, "I worry a lot."),
        (4, "Extraversion", 1, "I laugh aloud."), (5, "Extraversion", -1, "I frown often.")]
    assert rows[0].facet_code == "N1" and rows[0].facet_name == "CALM" and rows[4].facet_name == "JOY"


def test_key_pivot_roundtrip(spark):
    df = spark.createDataFrame([("f", TEXT)], "file_id string, text string")
    long = key_from_inventory(parse_inventory(df))
    wide = key_wide(long)
    assert wide.count() == 6
    back = keyed_items(key_long(wide)).select("item_id", "question", "trait", "weight")
    assert sorted(back.collect()) == sorted(long.select("item_id", "question", "trait", "weight").collect())
    assert keyed_items(long, ["Neuroticism"], 1.0).count() == 2


def test_inventory_file_with_windows_line_endings(spark):
    import os
    import tempfile
    from traitgrid.sources.inventory import read_inventory_text
    d = tempfile.mkdtemp(prefix="tg-crlf-")
    with open(os.path.join(d, "inv.txt"), "w", newline="") as f:
        f.write(TEXT.replace("\n", "\r\n"))
    rows = parse_inventory(read_inventory_text(spark, os.path.join(d, "inv.txt"))).orderBy("item_no").collect()
    assert [(r.trait, r.sign, r.question) for r in rows][:3] == [
        ("Neuroticism", 1, "I stay calm."), ("Neuroticism", 1, "I relax often."), ("Neuroticism", -1, "I panic easily.")]
    assert len(rows) == 6
