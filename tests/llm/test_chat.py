"""Speakers that training has not seen, in ways of writing it has not seen."""

import itertools

import pytest
from pyspark.sql import functions as F

from traitgrid.llm import chat

SF = "/root/testdata/sf0.01/conversations.parquet"


@pytest.fixture(scope="module")
def learned(spark):
    return chat.trained(chat.written(spark.read.parquet(SF)))


def _transcripts(spark, write):
    """Turns of whole conversations with user and assistant, written by ``write(i, role)``."""
    rows = spark.read.parquet(SF).filter("role in ('user', 'assistant', 'system')").orderBy("conv_id", "turn").collect()
    for i, (_, turns) in enumerate(itertools.groupby(rows, key=lambda r: r.conv_id)):
        t = [(chat.ROLES.index(x.role), x.text) for x in turns]
        if len(t) >= 4:
            yield t, "\n".join(write(i, r) + text for r, text in t)


UNSEEN = {
    "new names": lambda i, r: [["Moderator", "Wanda", "Xaver"], ["Intro", "Yusuf", "Zoe"]][i % 2][r] + ": ",
    "numbered speakers": lambda i, r: f"SPEAKER_0{(r + i) % 3}: ",
    "angle brackets": lambda i, r: "<" + ["meta", "kim", "lou"][r] + "> ",
    "two words": lambda i, r: ["Stage Direction", "Mr. Pym", "Dr. Quist"][r] + " >> ",
}


@pytest.mark.parametrize("name", UNSEEN)
def test_accuracy_on_unseen_styles_and_names(spark, learned, name):
    tables, model = learned
    right = total = split = 0
    for turns, text in itertools.islice(_transcripts(spark, UNSEEN[name]), 150):
        got = chat.parse(model, text, chat.find_roles(tables, text))
        right += sum(a == b for (a, _), (b, _) in zip(turns, got))
        total += len(turns)
        split += len(got) == len(turns)
    print(name, right / total)
    assert right / total > 0.85


def test_markers_are_taken_off(learned):
    tables, model = learned
    text = "Wanda: How do I sort a list?\nXaver: Use sorted.\nIt is stable.\nWanda: And in place?\nXaver: list.sort does that."
    turns = chat.parse(model, text, chat.find_roles(tables, text))
    assert [r for r, _ in turns] == [1, 2, 1, 2] and turns[1][1] == "Use sorted.\nIt is stable."
    assert turns[0][1] == "How do I sort a list?"


def test_rows_without_a_conversation_are_apart(spark):
    rows = [(None, 0, "user", "one"), (None, 0, "user", "two"), (None, 1, "assistant", "three"), (None, 1, "assistant", "three"), (7, 0, "user", "four")]
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, own int, speakers string, r int").repartition(3)
    out = chat.format_conversations(d).collect()
    assert len(out) == 4 and all(sum(t in r.rendered for r in out) == 1 for t in ("one", "two", "three", "four"))
    long = spark.createDataFrame([(1, 0, "user", "line\n" * 200_000)], "conv_id long, turn long, role string, text string")
    assert sum(r.n_lines for r in chat.format_conversations(long).collect()) in (200_001, 200_002)  # a style may put the speaker on a line of its own


def test_turns_are_shuffled_once(spark):
    d = chat.written(spark.read.parquet(SF)).withColumn("held_out", F.lit(False))
    both = chat.with_speakers(d, chat.Tables({}))
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
