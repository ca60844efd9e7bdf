"""The queries of this subpackage and their SQL."""

from interfera.llm import bpe, decontam, langid, lattice, license, minhash, pii, quality, secrets, sharding

QUERIES = {
    f.__name__: f
    for f in (
        pii.op1_boosted_pii, decontam.op2_suffix_decontam, lattice.op3_e8_lattice, minhash.op4_circulant_minhash,
        sharding.op5_interleaved_shards, secrets.op6_trigram_secrets, quality.op7_bradley_terry_quality,
        bpe.op8_byte_bpe, langid.op9_hyperdimensional_language, license.op10_template_licenses,
    )
}

SQL = {
    "op2_suffix_decontam": decontam.OP2_SQL,
    "op3_e8_lattice": lattice.OP3_SQL,
    "op4_circulant_minhash": minhash.OP4_SQL,
}
