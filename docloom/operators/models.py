"""Model table and rule-based model selection as ordered conditions over a relation of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known embedding models with dimension and context length, and the names that rules choose (model, fallback).
EMBEDDING_MODELS = {
    "nomic-embed-text": (768, 2048),
    "mxbai-embed-large": (1024, 512),
    "snowflake-arctic-embed": (1024, 512),
    "jina/jina-embeddings-v2-base-en": (768, 8192),
    "sentence-transformers/all-MiniLM-L6-v2": (384, 256),
}
LLM_CHOICES = {
    "large": ("ollama.llama3.1_70b", "ollama.llama3.1_8b"),
    "code": ("ollama.codellama_13b", "ollama.llama3.1_8b"),
    "fast": ("ollama.phi3_mini", "ollama.mistral_7b"),
    "other_language": ("ollama.qwen2_7b", "ollama.llama3.1_8b"),
    "default": ("ollama.llama3.1_8b", "ollama.mistral_7b"),
}
EMBEDDING_CHOICES = {
    "technical": ("ollama.mxbai_embed_large", "ollama.nomic_embed_text"),
    "multilingual": ("ollama.multilingual_e5_large", "ollama.nomic_embed_text"),
    "fast": ("ollama.all_minilm_l6_v2", "ollama.nomic_embed_text"),
    "default": ("ollama.nomic_embed_text", "ollama.all_minilm_l6_v2"),
}


def _choice(table: dict[str, tuple[str, str]], key: Column) -> Column:
    pairs = F.create_map(*(x for k, (m, f) in table.items() for x in (F.lit(k), F.struct(F.lit(m).alias("model"), F.lit(f).alias("fallback")))))
    return F.element_at(pairs, key)


def llm(length: Column, complexity: Column, task: Column, urgent: Column, language: Column) -> Column:
    """Struct of model and fallback; the first condition that holds decides, and nulls meet none."""
    rule = F.when((length > 5000) | (complexity == "high"), "large").when(task == "code_analysis", "code").when(urgent, "fast").when((language != "en") & (language != "de"), "other_language").otherwise("default")
    return _choice(LLM_CHOICES, rule)


def embedding(kind: Column, domain: Column, multilingual: Column, mode: Column) -> Column:
    rule = F.when((kind == "technical") | (domain == "engineering"), "technical").when(multilingual, "multilingual").when(mode == "fast", "fast").otherwise("default")
    return _choice(EMBEDDING_CHOICES, rule)


def embedding_models(spark) -> DataFrame:
    return spark.createDataFrame([(k, d, c) for k, (d, c) in EMBEDDING_MODELS.items()], "model string, dimension int, context_length int")
