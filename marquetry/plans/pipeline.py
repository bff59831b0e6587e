"""The whole evaluation in one go: split, grids, selection, gate, production, utilities and evidence, each published.

    python -m marquetry.plans.pipeline SF_DIR FOLDER
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions.contracts import ContractError
from marquetry.functions.hashing import semantic_sha256
from marquetry.operators import evaluation, ranking
from marquetry.plans import evaluate, orchestrate, tables
from marquetry.plans.monitor import Monitor
from marquetry.sources import files
from marquetry.sources.scratch import saver


@dataclass(frozen=True)
class EstimatorSpec:
    """What an estimator is: its family, configuration and seeds. Its id is the digest of all of it."""

    family: str
    configuration: tuple[tuple[str, Any], ...]
    seeds: tuple[int, ...]

    def __post_init__(self):
        names = [k for k, _ in self.configuration]
        if self.family not in ("popularity", "als", "bpr") or len(names) != len(set(names)) or "configuration_id" not in names:
            raise ContractError(f"no estimator: {self.family} {names}")
        if not self.seeds or len(set(self.seeds)) != len(self.seeds):
            raise ContractError("seeds must differ, and there must be one")

    @property
    def spec_id(self) -> str:
        return semantic_sha256(asdict(self) | {"configuration": dict(self.configuration)})


def specs(grids: Mapping[str, Sequence[Mapping[str, Any]]], seeds: Sequence[int]) -> list[EstimatorSpec]:
    """A spec for each configuration of each family, in order of family and id."""
    return [EstimatorSpec(family, tuple(sorted(c.items())), tuple(seeds)) for family in sorted(grids) for c in sorted(grids[family], key=lambda c: c["configuration_id"])]


def assemble_evidence(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """(folder, table, rows, digest) of published folders, every table checked against its manifest."""
    rows = []
    for folder in folders:
        files.verify_published(spark, folder)
        for name, entry in files.read_manifest(spark, f"{folder}/manifest.json")["tables"].items():
            rows.append((folder.rstrip("/").rsplit("/", 1)[-1], name, int(entry["rows"]), entry["digest"]))
    return spark.createDataFrame(rows, "folder string, table string, rows long, digest string")


def run(spark: SparkSession, sf_dir: str, folder: str, grids: Mapping[str, Sequence[Mapping[str, Any]]], seeds: Sequence[int], protocol: str = "protocol", max_seconds: float | None = None) -> dict[str, Any]:
    """Fit and rank every configuration and seed, select, gate against popularity, and publish results and evidence.

    Runs that a folder already holds are kept, so a stopped run goes on where it was. Returns the verdict of the gate.
    """
    ready, save = evaluate.prepare(spark, sf_dir), saver(spark)
    fits = {
        "popularity": orchestrate.fit_popularity,
        "als": lambda r, c, s: orchestrate.fit_als_counts(r, c, s, save),
        "bpr": lambda r, c, s: orchestrate.fit_bpr_counts(r, c, s, save),
    }
    known = specs(grids, seeds)
    rows = None
    with Monitor(spark, max_seconds=max_seconds) as watch:
        for family in sorted(grids):
            mine = orchestrate.run_grid(spark, folder, ready, grids[family], seeds, family, fits[family], protocol)
            rows = mine if rows is None else rows.unionByName(mine)
        board = save(orchestrate.leaderboard(rows))
        chosen = save(evaluation.select_configuration(board, len(seeds)))
        best = rows.join(F.broadcast(chosen.select("family", "configuration_id")), ["family", "configuration_id"], "left_semi")  # one row per family
        others = [f for f in sorted(grids) if f != "popularity"]
        verdict = orchestrate.gate(best, rows.where("family = 'popularity'"), others) if others else {"families": ["popularity"], "override": False}
        segments = evaluation.segments(evaluate.described(best, ready.trained).fillna(0, ["target_training_support"]), ["family"], {"activity": evaluation.band_code("user_activity", tables.BANDS), "support": evaluation.band_code("target_training_support", tables.BANDS)})
        result = f"{folder}/results-{semantic_sha256([protocol, *[s.spec_id for s in known]])[:12]}"
        if not files.exists(spark, f"{result}/manifest.json"):
            files.publish(spark, result, {"leaderboard": board, "selected": chosen, "segments": segments}, {"specs": [s.spec_id for s in known], "families": verdict["families"]})
    evidence = assemble_evidence(spark, [result])
    return {"verdict": verdict, "result": result, "evidence": evidence, "monitor": watch.summary()}


def inclusion_report(ready: evaluate.Prepared, k: int = 20) -> DataFrame:
    """Expected coverage of popularity's first k, as one row."""
    shown = ranking.item_top_k_inclusion(evaluate.item_scores(ready, "popularity"), ready.targets, ready.hidden, k)
    return ranking.expected_coverage(shown, ready.warm.count())


def main(argv: Sequence[str]) -> None:
    from marquetry.session import session

    spark = session("evaluation")
    scheme = [{"id": "own", "alpha_p": 0, "tau": 1}]
    grids = {"popularity": [{"configuration_id": "popularity"}], "als": orchestrate.als_grid([64], [0.05], [20], scheme), "bpr": orchestrate.bpr_grid([64], [1e-4], [0.1])}
    print(run(spark, argv[0], argv[1], grids, [104_729])["verdict"])


if __name__ == "__main__":
    main(sys.argv[1:])
