"""The queries of this package and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from functools import wraps

from dossier.llm.byte_bpe import op12_byte_bpe
from dossier.llm.centroids import op13_centroid_clusters
from dossier.llm.common import ship
from dossier.llm.hmm import op7_hmm_scoring
from dossier.llm.license_scan import op1_license_scan
from dossier.llm.merge_dropout import op8_merge_dropout
from dossier.llm.nearest import op5_nearest_vectors
from dossier.llm.packing import op4_best_fit_packing
from dossier.llm.periodic_runs import op11_periodic_runs
from dossier.llm.quality_classifier import op9_quality_classifier
from dossier.llm.quality_rules import op10_quality_rules
from dossier.llm.simhash import op6_simhash
from dossier.llm.suffix_dedup import op2_suffix_dedup
from dossier.llm.twins import SQL
from dossier.llm.url_filters import op3_url_filters, url_rules


def shipped(query):
    """``query`` after handing the package to the executors."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    query.__name__: shipped(query)
    for query in (
        op1_license_scan, op2_suffix_dedup, op3_url_filters, op4_best_fit_packing, op5_nearest_vectors,
        op6_simhash, op7_hmm_scoring, op8_merge_dropout, op9_quality_classifier, op10_quality_rules,
        op11_periodic_runs, op12_byte_bpe, op13_centroid_clusters, url_rules,
    )
}

ORACLE_SQL: dict[str, str] = SQL
