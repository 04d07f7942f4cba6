"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from contourflow import bindings as B
from contourflow import queries as library
from contourflow.operators import descriptors
from contourflow.session import local_session

HEADLINE = [
    "descriptor_projection", "g2", "g4", "acsf_radial", "acsf_angular", "min_projection", "neighbors",
    "knn_edges", "hybrid_edges", "cluster_graph", "silhouette", "stencil_gradient", "parity_metrics",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name: str, make) -> None:
        start = time.time()
        make().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)

    for name in HEADLINE:
        timed(name, lambda name=name: library.QUERIES[name](spark, sf))
    # the published workload: 4400 points, 34 atoms, radius 5, by radial and angular order
    points = B.points(spark, sf).where("point_index < 4400")
    nation = B.atoms(spark, sf)
    atoms = nation.union(nation.where("atom_index < 9").selectExpr("atom_index + 25", "symbol", "ax + 0.5", "ay", "az + 0.5"))
    box = (10.0, 10.0, 20.0)
    for radial, angular in ((40, 0), (120, 0), (500, 0), (40, 4), (40, 100)):
        timed(f"published_acsf_r{radial}_a{angular}", lambda r=radial, a=angular: descriptors.descriptor_arrays(points.repartition(8), atoms, box, 5.0, r, a))
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
