"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator group of the inventory, over the derived fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitgrid.functions.files import cohort_labels, cohort_of, cohorts_of, parse_run_file
from traitgrid.functions.models import api_model_name, provider
from traitgrid.functions.prompts import AGREEMENT_INTRO, agreement_prompt, chat_prompt
from traitgrid.functions.ratings import digit_strings, extract_number, rating_text, rating_value
from traitgrid.functions.rewards import format_reward, hash_answer, rating_reward, xml_answer
from traitgrid.functions.text import first_char, strip_echo
from traitgrid.operators import collect, grid, instrument, report, scoring, training
from traitgrid.plans import fixtures as fx
from traitgrid.schemas import GRID_TRAITS, TRAITS
from traitgrid.session import parallelism

RUN = ["model", "value"]
GRID_MODELS = ["A", "N", "R"]
RESUME_MODELS = ["A", "N", "O", "R"]


def trait_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = scoring.trait_scores(fx.d1_responses(spark, sf), fx.d2_key(spark, sf), RUN)
    return s.select("model", "value", "trait", "n_keyed", "n_valid", "n_na", "mean", "std")


def score_card(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_card(fx.d1_responses(spark, sf), fx.d2_key(spark, sf), RUN)


def score_parse_series(spark: SparkSession, sf: str) -> DataFrame:
    return report.score_series(score_card(spark, sf), RUN)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.trait_scores(fx.d1_responses(spark, sf), fx.d2_key(spark, sf), RUN)


def dose_response_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.dose_response_table(_scores(spark, sf), ["model"], "value", GRID_TRAITS)


def report_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return report.markdown_lines(dose_response_report(spark, sf), ["model"], "value", GRID_TRAITS)


def rating_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.rating_counts(fx.d1_responses(spark, sf), RUN)


def target_mse(spark: SparkSession, sf: str) -> DataFrame:
    # prompted intensity 1..9 mapped linearly onto the 1..5 scale
    return scoring.target_mse(_scores(spark, sf), (F.col("value") + 1) / 2.0, RUN)


def key_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = instrument.key_wide(fx.d2_key(spark, sf))
    return instrument.key_long(wide)


def key_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    k = fx.d2_key(spark, sf)
    code = F.element_at(F.array(*[F.lit(c) for c in "EACNO"]), (F.col("item_id") % 5).cast("int") + 1)
    k = k.withColumn("trait", instrument.trait_of_code(code))
    return instrument.key_wide(k)


def trait_item_subsets(spark: SparkSession, sf: str) -> DataFrame:
    return instrument.keyed_items(fx.d2_key(spark, sf), GRID_TRAITS)


def extract_ratings(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents")
    num = extract_number("text")
    return d.select("doc_id", F.size(digit_strings("text")).alias("n_numbers"), num.alias("number_extracted"),
                    rating_text(num).alias("rating_text"), rating_value(rating_text(num)).alias("rating"))


def resolve_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return collect.resolve_attempts(fx.d3_attempts(spark, sf), ["item_id"], ["ts", "call_id"], max_attempts=10)


def batch_timing(spark: SparkSession, sf: str) -> DataFrame:
    return collect.batch_timing(resolve_attempts(spark, sf), [], "item_id", batch_size=20)


def inventory_items(spark: SparkSession, sf: str) -> DataFrame:
    return instrument.parse_inventory(fx.d4_inventory(spark, sf))


def prompt_grid(spark: SparkSession, sf: str) -> DataFrame:
    return grid.prompt_grid(fx.d2_key(spark, sf), fx.d5_personas(spark), GRID_MODELS, repetitions=2)


def _done_cells(spark: SparkSession, sf: str) -> DataFrame:
    keyed = instrument.keyed_items(fx.d2_key(spark, sf)).select("item_id", "trait")
    return grid.done_cells(fx.d1_responses(spark, sf).join(keyed, "item_id"))


def pending_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = grid.grid_cells(spark, RESUME_MODELS, GRID_TRAITS)
    return grid.pending_cells(cells, _done_cells(spark, sf))


def present_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = grid.grid_cells(spark, RESUME_MODELS, GRID_TRAITS)
    return grid.present_cells(cells, _done_cells(spark, sf))


def scripted_responder():
    """Deterministic stand-in for a model: the reply digit cycles with the
    attempt; prompts whose length is a multiple of 13 never get a number."""
    def ask(prompts, attempt):
        n = prompts.str.len()
        text = "I would say " + ((n + 3 * attempt) % 7).astype(str)
        return text.where(n % 13 != 0, "no idea")
    return ask


def collect_responses(spark: SparkSession, sf: str) -> DataFrame:
    ids = ["model", "trait", "value", "repetition", "item_id"]
    prompts = grid.prompt_grid(fx.d2_key(spark, sf), fx.d5_personas(spark), ["A"], repetitions=1)
    attempts = collect.collect_responses(prompts, scripted_responder, ids, max_attempts=10,
                                         num_partitions=parallelism(spark))
    res = collect.resolve_attempts(attempts, ids, ["attempt"], max_attempts=10)
    return res.select(*ids, "attempt", "n_calls", "response_text", "rating_text")


def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "conversations")
    m = c.select("conv_id", "turn", F.posexplode(chat_prompt("text", AGREEMENT_INTRO)).alias("msg_pos", "msg"))
    return m.select("conv_id", "turn", "msg_pos", "msg.role", "msg.content")


def cohort_histogram(spark: SparkSession, sf: str) -> DataFrame:
    # labels come out of a generator, so the label filter cannot be pushed into the names' expressions
    d = fx.d6_run_names(spark, sf).select("level", F.explode(cohorts_of("file_name")).alias("cohort"))
    return report.cohort_histogram(d, "cohort", "level", bins=5, cohorts=cohort_labels())


def run_names(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.d6_run_names(spark, sf).withColumn("p", parse_run_file("file_name"))
    return d.select("event_id", "file_name", "p.model", "p.trait", "p.stamp",
                    F.date_format("p.run_ts", "yyyy-MM-dd HH:mm:ss").alias("run_ts"),
                    provider("p.model").alias("provider"), api_model_name("p.model").alias("api_model"),
                    cohort_of("file_name").alias("cohort"))


def train_eval_split(spark: SparkSession, sf: str) -> DataFrame:
    ex = training.training_examples(fx.d2_key(spark, sf), "Neuroticism", 1.0, "5")
    return training.train_eval_split(ex, ["item_id"], n_eval=16)


REWARDS = {"rating_reward": (rating_reward, 1.0), "format_reward": (format_reward, 0.2)}
_D7_IDS = ["prompt_id", "line_no", "part_id", "supp_id"]


def completion_rewards(spark: SparkSession, sf: str) -> DataFrame:
    d = training.score_completions(fx.d7_completions(spark, sf), REWARDS)
    return d.select(*_D7_IDS, "completion", "rating_reward", "format_reward", "reward")


def group_advantage(spark: SparkSession, sf: str) -> DataFrame:
    d = training.score_completions(fx.d7_completions(spark, sf), REWARDS)
    g = training.group_advantage(d, "prompt_id", "reward")
    return g.select(*_D7_IDS, "reward", (F.round("advantage", 6) + F.lit(0.0)).alias("advantage"))


def answer_extract(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.d7_completions(spark, sf)
    return d.select(*_D7_IDS, xml_answer("completion").alias("xml_answer"),
                    hash_answer("completion").alias("hash_answer"))


def echo_strip(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.d7_completions(spark, sf).withColumn("response", F.concat("prompt", "completion"))
    reply = strip_echo("response", "prompt")
    return d.select(*_D7_IDS, reply.alias("reply"), first_char(reply).alias("first_char"))


def local_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The local runner's prompts for every item: once without a persona and once
    with the 'high'/'extremely' Neuroticism persona (first match by value)."""
    items = fx.d2_key(spark, sf).select("item_id", "question")
    persona = grid.persona_prefix(fx.d5_personas(spark), "Neuroticism", "high", "extremely").scalar()
    base = items.select(F.lit("baseline").alias("run"), "item_id", agreement_prompt("question").alias("prompt"))
    pers = items.select(F.lit("Neuroticism").alias("run"), "item_id", agreement_prompt("question", persona).alias("prompt"))
    return base.unionByName(pers)


#: Files a micro-batch of the streaming scorer takes.
LIVE_FILES = 4


def live_trait_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming scorer run to completion over the response table landing as
    several files; must equal the batch ``trait_scores``."""
    from traitgrid.session import shared_path
    from traitgrid.streaming import start_live_scores
    resp, key = fx.d1_responses(spark, sf), fx.d2_key(spark, sf)
    src, out = shared_path(spark, "live-src"), shared_path(spark, "live-out")
    resp.write.parquet(src)  # as many files as the scan has tasks
    q = start_live_scores(spark, src, resp.schema, key, RUN, out,
                          max_files_per_trigger=LIVE_FILES, available_now=True)
    q.awaitTermination()
    return spark.read.parquet(out).select("model", F.col("value").cast("int").alias("value"), "trait",
                                          "n_keyed", "n_valid", "n_na", "mean", "std")


def outage_responder():
    """``scripted_responder`` while the model is partly down: every fifth prompt (by
    length) gets no reply."""
    ask = scripted_responder()
    return lambda prompts, attempt: ask(prompts, attempt).where(prompts.str.len() % 5 != 0, None)


def resume_after_outage(spark: SparkSession, sf: str) -> DataFrame:
    """The grid run while calls fail, then again with the model up: no reply is
    lost, so the scores are those of an undisturbed run."""
    from traitgrid.plans.experiment import run_experiment
    from traitgrid.session import shared_path
    args = (spark, fx.d2_key(spark, sf), fx.d5_personas(spark), ["A"], GRID_TRAITS, shared_path(spark, "outage"))
    run_experiment(*args, outage_responder, max_attempts=10, max_call_failures=1, retry_pause_s=0.0)
    run_experiment(*args, scripted_responder, max_attempts=10)
    return _cell_scores(spark, args[-1])


def crash_between_writes(spark: SparkSession, sf: str) -> DataFrame:
    """The grid run stopped before each of its writes in turn, then run to the end: no reply is asked for
    twice or lost, no cell has responses without scores, so the scores are those of an undisturbed run."""
    from traitgrid.plans.experiment import run_experiment
    from traitgrid.session import shared_path
    args = (spark, fx.d2_key(spark, sf), fx.d5_personas(spark), ["A"], GRID_TRAITS, shared_path(spark, "crash"), scripted_responder)
    for step in ("attempts", "state", "responses", "scores", "commit"):
        def stop(now, at=step):
            if now == at:
                raise InterruptedError(at)
        try:
            run_experiment(*args, max_attempts=10, before=stop)
        except InterruptedError:
            pass
    run_experiment(*args, max_attempts=10)
    return _cell_scores(spark, args[5])


def _cell_scores(spark: SparkSession, root: str) -> DataFrame:
    from traitgrid.plans.experiment import results
    return results(spark, root, "scores").select("model", "trait", "value", "repetition", "n_keyed", "n_valid", "n_na", "mean", "std")


def experiment_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The durable grid runner end to end (prompts → scripted replies → attempts
    → responses → cell scores) for one model over the grid traits."""
    from traitgrid.plans.experiment import run_experiment
    from traitgrid.session import shared_path
    root = shared_path(spark, "experiment")
    run_experiment(spark, fx.d2_key(spark, sf), fx.d5_personas(spark), ["A"], GRID_TRAITS, root, scripted_responder, max_attempts=10)
    return _cell_scores(spark, root)


def result_tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Response files of every grid cell written as column-oriented JSON under their real names
    (``<model>/<trait>_<value>.json``), read back as one result tree and scored per cell from the files' own weights."""
    from traitgrid.session import shared_path
    from traitgrid.sinks.writers import write_response_files
    from traitgrid.sources.columns_json import read_result_tree
    root = shared_path(spark, "result-tree")
    rows, items, small = fx.d1_cell_rows(spark, sf)
    if small:  # the items' own columns are added once the rows are dealt to their files
        write_response_files(rows.drop("chunk"), root, "row_id", columns=["question", *TRAITS, "responses", "numbers_extracted", "elapsed_times"], beside=items, on="item_id")
    else:
        write_response_files(fx.d1_cell_files(spark, sf).drop("chunk"), root, index_col="row_id")
    tree = read_result_tree(spark, root, index_type="string")
    s = scoring.cell_scores(tree, None, ("model", "trait", "value"))
    return s.select("model", "trait", "value", "n_keyed", "n_valid", "n_na", "mean", "std")


def score_card_files(spark: SparkSession, sf: str) -> DataFrame:
    """Score cards written one file per run in the card layout, read back as a
    directory in one pass and parsed into series."""
    from traitgrid.session import shared_path
    from traitgrid.sinks.writers import write_score_card
    from traitgrid.sources.columns_json import read_score_cards
    path = shared_path(spark, "cards")
    write_score_card(score_card(spark, sf), path, run_cols=RUN)
    cards = read_score_cards(spark, path, path_glob=None)
    s = report.score_series(cards.withColumn("value", F.col("value").cast("int")), RUN)
    return s.select("model", "value", "trait", "score", "mean", "std")


def card_cohort_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Score cards of every run written to disk under their run file names, found again by the default
    reader, put into cohorts by their file names, and binned by their mean level."""
    from traitgrid.functions.ratings import format_score, parse_score, round_half_even
    from traitgrid.session import shared_path
    from traitgrid.sinks.writers import write_run_cards
    from traitgrid.sources.columns_json import read_score_cards
    total = F.sum(F.col("level").cast("decimal(18,6)")).cast("double")
    cards = fx.d6_run_names(spark, sf).groupBy("file_name").agg(
        format_score(round_half_even(total / F.count(F.lit(1))), F.lit(0.0)).alias("Neuroticism"), F.lit(0.0).alias("na_share"))
    path = shared_path(spark, "cohort-cards")
    write_run_cards(cards, path, traits=["Neuroticism"])
    found = read_score_cards(spark, path, ["Neuroticism"])
    levels = found.select(parse_score("Neuroticism", 1).alias("level"), F.explode(cohorts_of("file_name")).alias("cohort"))
    return report.cohort_histogram(levels, "cohort", "level", bins=5, cohorts=cohort_labels())


def card_union(spark: SparkSession, sf: str) -> DataFrame:
    """Cards whose files have unlike columns, one of them no known trait, written under their run file names and read
    as one table: every score of every file."""
    from traitgrid.functions.files import run_file_name
    from traitgrid.session import shared_path
    from traitgrid.sinks.writers import write_run_cards
    from traitgrid.sources.columns_json import read_score_cards
    stamp = F.make_timestamp(F.lit(2025), F.lit(1), F.col("value"), F.lit(12), F.lit(0), F.lit(0))
    name = run_file_name(F.concat(F.lit("org/"), "model"), F.lit("mixed"), stamp)
    card = score_card(spark, sf).withColumns({"file_name": name, "Honesty": F.col("Neuroticism")})
    path = shared_path(spark, "unlike-cards")
    write_run_cards(card.filter("value % 2 = 1"), path, traits=["Extraversion", "Agreeableness", "Conscientiousness"])
    write_run_cards(card.filter("value % 2 = 0"), path, traits=["Neuroticism", "Openness", "Honesty"])
    cards = read_score_cards(spark, path)
    traits = [c for c in cards.columns if c not in ("file_path", "file_name", "row_index", "na_share")]
    return report.score_series(cards, ["file_name", "na_share"], traits).filter("score is not null")


def persona_file_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The persona catalogue stored in the catalogue's column-oriented layout,
    read back and used for the local runner's prompts (same rows as
    ``local_prompts``)."""
    from traitgrid.session import shared_path
    from traitgrid.sinks.writers import write_columns_json
    from traitgrid.sources.columns_json import read_personas
    cat = fx.d5_personas(spark).select(
        (F.array_position(F.array(*[F.lit(t) for t in TRAITS]), F.col("domain")) * 10 + F.col("value")).alias("row"),
        F.col("domain").alias("Domain"),
        F.col("qualifier_type").alias("QualifierType"), F.col("qualifier").alias("Qualifier"),
        F.col("value").alias("Value"), F.col("description").alias("Description"))
    path = shared_path(spark, "personas")
    write_columns_json(cat, path, index_col="row", rows_per_file=10**6)
    personas = read_personas(spark, path)
    items = fx.d2_key(spark, sf).select("item_id", "question")
    persona = grid.persona_prefix(personas, "Neuroticism", "high", "extremely").scalar()
    base = items.select(F.lit("baseline").alias("run"), "item_id", agreement_prompt("question").alias("prompt"))
    pers = items.select(F.lit("Neuroticism").alias("run"), "item_id", agreement_prompt("question", persona).alias("prompt"))
    return base.unionByName(pers)


def training_split_files(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows (no index column) stored by split, and the training split
    read back with the split filter pruning the other directory."""
    from traitgrid.session import shared_path
    from traitgrid.sinks.writers import training_dataset
    from traitgrid.sources.results import read_split
    ex = training.train_eval_split(training.training_examples(fx.d2_key(spark, sf), "Neuroticism", 1.0, "5"),
                                   ["item_id"], n_eval=16)
    path = shared_path(spark, "training")
    training_dataset(ex, ("question", "prompt", "answer", "split")).write.partitionBy("split").parquet(path)
    return read_split(spark, path, "train").select("question", "prompt", "answer", "split")


def columns_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    from traitgrid.session import shared_path
    from traitgrid.sinks.writers import write_columns_json
    from traitgrid.sources.columns_json import read_columns_json
    wide = instrument.key_wide(fx.d2_key(spark, sf))
    path = shared_path(spark, "key-json")
    write_columns_json(wide, path, index_col="item_id", rows_per_file=500)
    schema = {"question": "string", **{t: "double" for t in TRAITS}}
    back = read_columns_json(spark, path, schema, index_name="item_id", recursive=True)
    return back.select("item_id", "question", *TRAITS)  # must equal the one-hot key


def inventory_files(spark: SparkSession, sf: str) -> DataFrame:
    """Inventory texts written as text files, read back and parsed: the items of every file."""
    from traitgrid.session import shared_path
    from traitgrid.sources.inventory import read_inventory_text
    path = shared_path(spark, "inventory")
    fx.d4_inventory(spark, sf).repartition("file_id").write.partitionBy("file_id").text(path, lineSep="\n")
    items = instrument.parse_inventory(read_inventory_text(spark, path))
    return items.withColumn("file_id", F.regexp_extract("file_id", r"/file_id=(\d+)/", 1).cast("long"))


def run_file_list(spark: SparkSession, sf: str) -> DataFrame:
    """The files of a folder of score cards, by name, with what their names say."""
    from traitgrid.session import shared_path
    from traitgrid.sinks.writers import write_run_cards
    from traitgrid.sources.results import list_files
    cards = fx.d6_run_names(spark, sf).select("file_name", F.lit("3.0+-0.0").alias("Openness"), F.lit(0.0).alias("na_share")).distinct()
    path = shared_path(spark, "run-files")
    write_run_cards(cards, path, traits=["Openness"])
    found = list_files(spark, path, "*.json")
    return found.select("file_name", parse_run_file("file_name").alias("p")).select("file_name", "p.model", "p.trait")


def listed_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Grid cells that a result table has, and how many of its model, from the names of its folders alone."""
    from traitgrid.session import shared_path
    from traitgrid.sinks.writers import write_cells
    from traitgrid.sources.results import list_cells, list_models
    keyed = instrument.keyed_items(fx.d2_key(spark, sf)).select("item_id", "trait")
    path = shared_path(spark, "cells")
    write_cells(fx.d1_responses(spark, sf).join(keyed, "item_id"), path)
    done = list_cells(spark, path)
    cells = grid.grid_cells(spark, RESUME_MODELS, GRID_TRAITS).join(list_models(done), "model", "left_semi")
    return grid.present_cells(cells, done)


def any_reply(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts resolved where every reply is accepted: the first successful call."""
    return collect.resolve_attempts(fx.d3_attempts(spark, sf), ["item_id"], ["ts", "call_id"], max_attempts=10, allowed=None)


def first_character(replies):
    """The parser of one-token replies, for the calls: the first character of each stripped text."""
    return replies.str.strip().str[:1]


def parsed_responder():
    """Deterministic stand-in for a model that answers in one token, valid or not, and goes on."""
    return lambda prompts, attempt: " " + ((prompts.str.len() + 3 * attempt) % 7).astype(str) + " of 9"


def parsed_experiment(spark: SparkSession, sf: str) -> DataFrame:
    """The grid run with a parser of its own (the first character) for calls and replies."""
    from traitgrid.plans.experiment import results, run_experiment
    from traitgrid.session import shared_path
    root = shared_path(spark, "parsed")
    run_experiment(spark, fx.d2_key(spark, sf), fx.d5_personas(spark), ["A"], ["Openness"], root, parsed_responder, max_attempts=10,
                   parser=first_char, reply_parser=first_character)
    return results(spark, root, "responses").select("model", "trait", "value", "repetition", "item_id", "attempt", "n_calls", "response_text", "rating_text")


def split_by_trait(spark: SparkSession, sf: str) -> DataFrame:
    """The training rows of every trait, split for each trait by itself."""
    items = instrument.keyed_items(fx.d2_key(spark, sf), sign=1.0).select("trait", "item_id", "question")
    return training.train_eval_split(items, ["item_id"], n_eval=16, by=["trait"])


def target_table_mse(spark: SparkSession, sf: str) -> DataFrame:
    """Scores against a table of targets: a trait's target at a prompted intensity, none for two of the traits."""
    targets = fx.d5_personas(spark).filter(F.col("domain").isin(*GRID_TRAITS)).select(
        F.col("domain").alias("trait"), "value", (F.col("value") / 2.0).alias("target"))
    return scoring.target_mse(_scores(spark, sf), targets, RUN)


def list_rewards(completions, line_no):
    """A reward over lists: a short completion of an early line is worth more."""
    return [None if c is None else 2.0 - 0.125 * len(c) - 0.25 * n for c, n in zip(completions, line_no, strict=True)]


def mixed_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """Reward functions of both forms: Columns, and functions over lists in one Python pass."""
    rewards = REWARDS | {"brevity": (training.BatchReward(list_rewards, ("line_no",)), 0.5),
                         "digits": (training.BatchReward(lambda completions: [sum(ch in "0123456789" for ch in c) for c in completions]), -0.25)}
    d = training.score_completions(fx.d7_completions(spark, sf), rewards)
    return d.select(*_D7_IDS, "rating_reward", "format_reward", "brevity", "digits", "reward")


def bucketed_advantage(spark: SparkSession, sf: str) -> DataFrame:
    """Group-relative advantages from completions stored in buckets of their prompts (rewards computed once)."""
    from traitgrid.session import shared_path
    scored = training.score_completions(fx.d7_completions(spark, sf), REWARDS)
    stored = training.store_completions(scored, shared_path(spark, "completions"), "prompt_id")
    g = training.stored_advantage(spark, stored, "prompt_id", "reward")
    return g.select(*_D7_IDS, "reward", (F.round("advantage", 6) + F.lit(0.0)).alias("advantage"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "trait_scores": trait_scores,
    "score_card": score_card,
    "score_parse_series": score_parse_series,
    "dose_response_report": dose_response_report,
    "report_markdown": report_markdown,
    "rating_counts": rating_counts,
    "target_mse": target_mse,
    "key_unpivot": key_unpivot,
    "key_one_hot": key_one_hot,
    "trait_item_subsets": trait_item_subsets,
    "extract_ratings": extract_ratings,
    "resolve_attempts": resolve_attempts,
    "batch_timing": batch_timing,
    "inventory_items": inventory_items,
    "prompt_grid": prompt_grid,
    "pending_cells": pending_cells,
    "present_cells": present_cells,
    "collect_responses": collect_responses,
    "chat_messages": chat_messages,
    "cohort_histogram": cohort_histogram,
    "run_names": run_names,
    "train_eval_split": train_eval_split,
    "completion_rewards": completion_rewards,
    "group_advantage": group_advantage,
    "answer_extract": answer_extract,
    "echo_strip": echo_strip,
    "local_prompts": local_prompts,
    "live_trait_scores": live_trait_scores,
    "experiment_scores": experiment_scores,
    "resume_after_outage": resume_after_outage,
    "crash_between_writes": crash_between_writes,
    "result_tree_scores": result_tree_scores,
    "score_card_files": score_card_files,
    "card_cohort_histogram": card_cohort_histogram,
    "card_union": card_union,
    "persona_file_prompts": persona_file_prompts,
    "training_split_files": training_split_files,
    "columns_json_roundtrip": columns_json_roundtrip,
    "inventory_files": inventory_files,
    "run_file_list": run_file_list,
    "listed_cells": listed_cells,
    "any_reply": any_reply,
    "parsed_experiment": parsed_experiment,
    "split_by_trait": split_by_trait,
    "target_table_mse": target_table_mse,
    "mixed_rewards": mixed_rewards,
    "bucketed_advantage": bucketed_advantage,
}
