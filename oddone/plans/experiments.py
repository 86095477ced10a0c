"""The reference's experiments as DataFrame plans, and the registry that runs a manifest.

* :func:`triplet_run` (E1): concepts + vectors -> draw -> shuffle -> render -> score -> answers
* :func:`embedding_run` (E2): answers (one run or a folder of runs) -> index -> split -> fit -> wide;
  :func:`embedding_for_model` / :func:`embedding_from_folder` are the two shipped embedding
  experiments (partition-pruned table read / one fit per CSV of a folder) with their argument checks
* :func:`run_manifest` (F7): resolve the manifest (J7), refuse dangling lines (J8), run each line
"""

from __future__ import annotations

import itertools
import warnings
from concurrent.futures import ThreadPoolExecutor
from typing import Callable

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddone.functions.prompts import render_template
from oddone.functions.text import safe_name
from oddone.operators.embedding import item_index, map_lenient, split_train_test
from oddone.operators.fitting import embedding_frame, fit, heldout_accuracy
from oddone.operators.sampling import draw_triplets, shuffle_yz, subset_k
from oddone.operators.scoring import score_prompts
from oddone.operators.vectors import candidates, first_vector, zip_lengths, zip_matrix
from oddone.operators.manifest import args_map, dangling, resolve
from oddone.sinks.writers import write_embedding


def stimuli_set(concepts: DataFrame, matrix: DataFrame | None, template: str, n_items: int = 1000,
                euclid_min: float = -1, euclid_max: float = -1, subset: int | None = None, seed: int = 0,
                shuffle: bool = True) -> DataFrame:
    """Stimuli with prompts (D4).  Vectors attach on the full table's row positions, then the
    optional subset is applied (the reference subsets first and misaligns vectors; fixed here)."""
    if matrix is not None:
        lengths = zip_lengths(concepts, matrix)
        if lengths["mismatch"]:
            warnings.warn(f"{lengths['matrix_rows']} vectors for {lengths['concept_rows']} concepts: the numbers differ, "
                          "rows are paired as far as both go")
    vecs = first_vector(zip_matrix(concepts, matrix)) if matrix is not None else None
    rows = subset_k(concepts, subset, seed=seed) if subset is not None else concepts
    if subset is not None:  # positions must stay dense for the draw
        rows = _renumber(rows)
    cand = candidates(rows, vecs)
    st = draw_triplets(cand, n_items, euclid_min, euclid_max, seed=seed, use_vectors=vecs is not None)
    st = shuffle_yz(st, seed=seed, shuffle=shuffle)
    return st.withColumn("format_str", render_template(template, {
        "item_x": "item_x", "item_y": "shuffled_item_y", "item_z": "shuffled_item_z"}))


def _renumber(rows: DataFrame) -> DataFrame:
    from oddone.operators.indexing import dense_index
    return dense_index(rows.withColumnRenamed("row_idx", "_orig"), ["_orig"], "row_idx").drop("_orig")


def triplet_run(stimuli: DataFrame, scorer: Callable, model: dict, batch_size: int = 6) -> DataFrame:
    """Answers for one model: tokens mode -> D5, logits mode -> D6 (plus the stimulus id).

    ``model`` is its battery row: ``choose_mode, answer_format, strip_echo``, ``vision`` for an image model,
    ``do_chat_template`` for one whose scorer renders the message column."""
    return score_prompts(stimuli, scorer, mode=model.get("choose_mode", "tokens"), batch_size=batch_size,
                         instr=model.get("answer_format"), strip_prompt_echo=model.get("strip_echo", True),
                         vision=bool(model.get("vision")), chat=bool(model.get("do_chat_template")))


def embedding_run(answers: DataFrame, d: int = 10, max_epochs: int = 50, seed: int = 42, run_col: str | None = None,
                  id_col: str | None = None, lr: float = 0.05, loss: str = "ste") -> tuple[DataFrame, DataFrame]:
    """Fit the train rows (80 % of each run) and judge the fit on the test rows.

    Returns ``([run,] item, id, dim_*)`` and ``([run,] n_test, n_correct, accuracy)``.  With ``run_col`` each run has
    its own index, split and fit; all runs share the epochs of one plan."""
    keys = (run_col,) if run_col else ()
    idx = item_index(answers, run_col)
    trip = map_lenient(answers, idx, run_col)
    if id_col is None:  # content key: deterministic under recomputation; equal rows are interchangeable
        trip = trip.withColumn("_tid", F.concat_ws(":", "h", "w", "l"))
        id_col = "_tid"
    trip = split_train_test(trip, id_col, seed=seed, group_col=run_col).checkpoint(eager=True)
    model = fit(trip.filter(~F.col("is_test")), idx, d, max_epochs, lr, seed, loss, keys)
    return embedding_frame(model, idx, d, keys), heldout_accuracy(trip.filter("is_test"), model, d, keys)


def run_manifest(spark: SparkSession, parsed: DataFrame, models: DataFrame, experiments: DataFrame, stimuli: DataFrame,
                 registry: dict[str, Callable], parallel: int = 1) -> list:
    """Refuse the whole manifest on a dangling reference; then call ``registry[experiment]`` per line with the model,
    experiment and stimulus row and the line's key=value arguments.  Returns what the calls returned, in line order.

    ``parallel`` lines run at a time (their jobs share the cluster).  A line that fails does not stop the others; when
    all have ended, an :class:`ExceptionGroup` of the failures is raised, each with its line number as a note, and the
    results as ``results`` (None where a line failed).  Lines come to the driver one by one, as they are started."""
    bad = dangling(parsed, models, experiments, stimuli)
    first = bad.orderBy("line_no").limit(1).collect()
    if first:
        raise ValueError(f"the manifest has dangling references, the first is line {first[0]['line_no']} "
                         f"({first[0]['reason']}); manifest.dangling() gives all")
    unknown = parsed.select("experiment").distinct().filter(~F.col("experiment").isin(list(registry))).limit(1).collect()
    if unknown:
        raise ValueError(f"no function is registered for experiment {unknown[0]['experiment']!r}")
    lines = resolve(parsed, models, experiments, stimuli).withColumn("kwargs", args_map(F.col("args"))).orderBy("line_no")
    failures: list[Exception] = []

    def one(row):
        try:
            return registry[row["experiment"]](row, **(row["kwargs"] or {}))
        except Exception as failure:  # noqa: BLE001
            failure.add_note(f"manifest line {row['line_no']}")
            failures.append(failure)
            return None

    rows, results = lines.toLocalIterator(), []
    with ThreadPoolExecutor(parallel) as pool:
        while part := list(itertools.islice(rows, 64 * parallel)):
            results += pool.map(inheritable_thread_target(spark)(one), part)
    if failures:
        group = ExceptionGroup(f"{len(failures)} of {len(results)} manifest lines failed", failures)
        group.results = results
        raise group
    return results


def embedding_from_folder(spark: SparkSession, version_dir: str | None, d: int = 30, max_epochs: int = 500,
                          seed: int = 42, out_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One fit per answer CSV directly inside ``version_dir`` (the run is the file's base name).

    With ``out_path`` the embeddings are written there, a folder per run."""
    from oddone.sources.files import read_answers
    if version_dir is None:
        raise ValueError("the folder experiment needs version_dir=… in its manifest line")
    try:
        answers = read_answers(spark, version_dir, run_from_file=True)
        answers.schema  # resolves the path
    except Exception as e:  # noqa: BLE001
        raise ValueError(f"the answer folder was not found: {version_dir!r}") from e
    emb, accuracy = embedding_run(answers, d=d, max_epochs=max_epochs, seed=seed, run_col="run")
    if out_path is not None:
        write_embedding(emb, out_path, partition_cols=("run",))
    return emb, accuracy


def embedding_for_model(spark: SparkSession, answers_path: str, version_dir: str | None, model: str,
                        stimulus: str, d: int = 30, max_epochs: int = 1000, seed: int = 42,
                        out_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One fit over the answers of ``(version, model, stimulus)`` in the partitioned answers table;
    partition filters prune the scan to that model's files.  With ``out_path`` the embedding goes into the table there,
    by version and (safe) model name."""
    if version_dir is None:
        raise ValueError("the model experiment needs version_dir=… in its manifest line")
    answers = (spark.read.parquet(answers_path)
               .filter((F.col("version") == version_dir) & (F.col("model") == model) & (F.col("stimulus") == stimulus))
               .select("head", "winner", "loser"))
    emb, accuracy = embedding_run(answers, d=d, max_epochs=max_epochs, seed=seed)
    if out_path is not None:
        named = emb.withColumns({"version": F.lit(version_dir), "model": safe_name(F.lit(model))})
        write_embedding(named, out_path, partition_cols=("version", "model"))
    return emb, accuracy
