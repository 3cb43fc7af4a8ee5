"""The queries opN_<name> of this subpackage, each over its whole table, and DuckDB SQL where SQL can say the same."""

from .decontaminate import contamination_report
from .jaccard import jaccard_report
from .language_model import lm_report
from .media import media_report
from .mixing import mix_sources
from .oracles import ORACLE_SQL  # noqa: F401
from .pii import pii_report
from .secrets import secret_report
from .substrings import substring_report
from .tokens import token_counts
from .toxicity import toxicity_report


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix(spark, sf_dir):
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_substrings(spark, sf_dir):
    return substring_report(_read(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return pii_report(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_tokens(spark, sf_dir):
    return token_counts(_read(spark, sf_dir, "documents"), _vocabulary(), inside=True, longest=None).drop("cut_chars")


def op6_decontaminate(spark, sf_dir):
    return contamination_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_secrets(spark, sf_dir):
    return secret_report(_read(spark, sf_dir, "documents")).drop("n_entropy")


def op8_lm(spark, sf_dir):
    return lm_report(_read(spark, sf_dir, "documents"))


def op9_media(spark, sf_dir):
    return media_report(_read(spark, sf_dir, "documents"))


def op10_jaccard(spark, sf_dir):
    return jaccard_report(_read(spark, sf_dir, "documents"))


QUERIES = {"op1_mix": op1_mix, "op2_substrings": op2_substrings, "op3_pii": op3_pii, "op4_toxicity": op4_toxicity, "op5_tokens": op5_tokens, "op6_decontaminate": op6_decontaminate, "op7_secrets": op7_secrets, "op8_lm": op8_lm, "op9_media": op9_media, "op10_jaccard": op10_jaccard}
