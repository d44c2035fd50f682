"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from sheaf.llm import bpe, byte_bpe, imatch, langid, lattice, licenses, mixing, negatives, quality, secrets, simhash, substring, trie


def queries() -> dict:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_language": langid.op2_language,
        "op3_bpe": bpe.op3_bpe,
        "op4_quality": quality.op4_quality,
        "op5_simhash": simhash.op5_simhash,
        "op6_lattice": lattice.op6_lattice,
        "op7_licenses": licenses.op7_licenses,
        "op8_substring": substring.op8_substring,
        "op9_mixing": mixing.op9_mixing,
        "op10_imatch": imatch.op10_imatch,
        "op11_bytes": byte_bpe.op11_bytes,
        "op12_trie": trie.op12_trie,
        "op13_negatives": negatives.op13_negatives,
    }


def oracle_sql() -> dict[str, str]:
    """License scans, the prefix trie and hard negatives can be said in SQL; the tests hold the others against brute force, round trips or held-out accuracy."""
    return {"op7_licenses": licenses.op7_sql(), "op12_trie": trie.op12_sql(), "op13_negatives": negatives.op13_sql()}
