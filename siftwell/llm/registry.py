"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, bpe, decontam, minhash, packing, pii, preference, quality, toxicity, urltree, vectorcode, warc, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_preference": preference.op2_preference,
    "op3_url": urltree.op3_url,
    "op4_decontaminate": decontam.op4_decontaminate,
    "op5_warc": warc.op5_warc,
    "op6_ann": ann.op6_ann,
    "op7_quality": quality.op7_quality,
    "op8_bpe": bpe.op8_bpe,
    "op9_minhash": minhash.op9_minhash,
    "op10_pii": pii.op10_pii,
    "op11_vectorcode": vectorcode.op11_vectorcode,
    "op12_packing": packing.op12_packing,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE = {**warc.SQL, **ann.SQL, **decontam.SQL, **preference.SQL, **minhash.SQL, **vectorcode.SQL}
