"""Queries of the training-data operators, by name; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import docs, encoding, mixing, packing, pii, provenance, secrets, split, syntax
from .common import table

#: Where the paths of the given tables name the project.
LAYOUT = "^/srv/(?:src|docs)/([^/]+)/"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: syntax.syntax_found(table(s, d, "files")),
    "p1_rates": lambda s, d: syntax.syntax_rates(table(s, d, "files"), LAYOUT),
    "p2_found": lambda s, d: provenance.provenance_found(table(s, d, "files"), table(s, d, "upstream_files"), LAYOUT),
    "p2_provenance": lambda s, d: provenance.provenance(table(s, d, "files"), table(s, d, "upstream_files"), LAYOUT),
    "p3_found": lambda s, d: secrets.secrets_found(table(s, d, "files")),
    "p3_redacted": lambda s, d: secrets.redacted(table(s, d, "files"), "file_id"),
    "p3_redacted_chunks": lambda s, d: secrets.redacted(table(s, d, "chunks"), "chunk_id"),
    "p4_found": lambda s, d: pii.pii_found(table(s, d, "turns"), table(s, d, "notes")),
    "p4_redacted": lambda s, d: pii.pii_redacted(table(s, d, "turns"), table(s, d, "notes")),
    "p5_found": lambda s, d: docs.pairs_found(table(s, d, "files")),
    "p5_pairs": lambda s, d: docs.pairs_once(table(s, d, "files"), LAYOUT),
    "p6_found": lambda s, d: split.split_found(table(s, d, "chunks")),
    "p6_pieces": lambda s, d: split.pieces(table(s, d, "chunks")),
    "p7_packed": lambda s, d: packing.pack(table(s, d, "documents")),
    "p7_fill": lambda s, d: packing.fill(packing.pack(table(s, d, "documents"))),
    "p7_invariants": lambda s, d: packing.invariants(table(s, d, "documents")),
    "p8_mixture": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"))[0],
    "p8_shares": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets"))[1],
    "p8_invariants": lambda s, d: mixing.invariants(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p9_found": lambda s, d: encoding.encoding_found(table(s, d, "documents")),
    "p9_restored": lambda s, d: encoding.restore(table(s, d, "documents")),
}

#: Packings and mixtures hold their invariants; a chunk comes out in pieces exactly if it is longer than the limit; what the pieces are is tested by putting them together.
ORACLES: dict[str, str] = {
    "p7_invariants": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS lost_tokens, 0::BIGINT AS gaps, 0::BIGINT AS split, 0::BIGINT AS overfull FROM documents WHERE length(text) > 0",
    "p8_invariants": "SELECT 0::BIGINT AS over_repeats, 0::BIGINT AS strange, 0::BIGINT AS partial, 0::BIGINT AS off_share, 0::BIGINT AS unsummed",
    "p6_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(content) > 2000",
}
