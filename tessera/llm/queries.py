"""The queries and SQL of this subpackage; __spark_entry__.py adds them where the subpackage can be imported."""

from tessera.llm import bytebpe, collocations, embeddings, langid, manifest, minhash, neighbours, packing, secrets, sharding, urlfilter, warc, webp


def queries() -> dict:
    return {
        "op1_embedding_dedup": embeddings.op1_embedding_dedup,
        "op2_minhash_dedup": minhash.op2_minhash_dedup,
        "op3_webp": webp.op3_webp,
        "op4_byte_bpe": bytebpe.op4_byte_bpe,
        "op5_langid": langid.op5_langid,
        "op6_warc": warc.op6_warc,
        "op7_secrets": secrets.op7_secrets,
        "op8_packing": packing.op8_packing,
        "op9_sharding": sharding.op9_sharding,
        "op10_url_filter": urlfilter.op10_url_filter,
        "op11_collocations": collocations.op11_collocations,
        "op12_neighbours": neighbours.op12_neighbours,
        "op13_manifest": manifest.op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": embeddings.oracle(),
        "op6_warc": warc.oracle(),
        "op10_url_filter": urlfilter.oracle(),
        "op11_collocations": collocations.oracle(),
        "op13_manifest": manifest.oracle(),
    }
