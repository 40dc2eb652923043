"""The queries of this subpackage and their checks."""

from __future__ import annotations

from weftline.llm import digest, packing, pairs, patterns, runs, sampling, secrets, sequence_sql, splitting, tokens, yaml_check

QUERIES = {
    f.__name__: f
    for f in (
        patterns.p1_found, patterns.p1_patterns, runs.p2_found, runs.p2_runs, runs.p2_event_runs,
        sampling.p3_found, sampling.p3_sample, sampling.p3_strata, sampling.p3_languages,
        yaml_check.p4_found, yaml_check.p4_files, yaml_check.p4_rates,
        digest.p5_found, digest.p5_percentiles, digest.p5_digests,
        pairs.p6_found, pairs.p6_pairs,
        secrets.p7_found, secrets.p7_places, secrets.p7_masked,
        tokens.p8_ids, packing.p9_bins, splitting.p10_pieces,
    )
}
ORACLES: dict[str, str] = {**sampling.ORACLES, **digest.ORACLES, **sequence_sql.ORACLES}
