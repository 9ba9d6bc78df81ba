"""Imports of whole conversation stores: what has changed since the last import is batched and summarised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import safe_key
from tessera.operators.answers import summaries
from tessera.operators.components import stored
from tessera.operators.sessions import MAX_BATCHES, batches, changed, clipped_turns, digests, rendered, turns
from tessera.sources.files import changed_files
from tessera.sources.transcripts import bubbles, composers, conversation_hash


def changed_conversations(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """(session, created, value, digest) of the conversations of a key-value table (key, value) whose hash is not the one that the
    manifest (session, digest) has."""
    found = composers(rows).withColumn("digest", conversation_hash(F.col("value")))
    latest = found.groupBy("session").agg(F.max_by(F.struct("created", "value", "digest"), F.struct("created", "digest")).alias("x")).select("session", "x.*")
    return changed(latest, manifest)


def imported_conversations(rows: DataFrame, manifest: DataFrame, provider: Callable[[str], str], *, namespace: str = "composer-session", max_chars: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(session, batch, path, body) with each batch summarised, the one before it as context, and the manifest (session, digest) after
    it. A batch that the provider fails on becomes an error text; the next run skips what has not changed."""
    new = changed_conversations(rows, manifest)
    found = turns(bubbles(new.select("session", "value")), "session", "pos")
    told = summaries(rendered(found, batches(found, max_chars, 0), namespace), _guarded(provider))
    path = F.format_string(f"{namespace}/%s-batch-%02d.md", F.substring("session", 1, 8), F.col("batch") + 1)
    after = manifest.select("session", "digest").join(new.select("session"), "session", "left_anti").unionByName(new.select("session", "digest"))
    return told.select("session", "batch", path.alias("path"), F.col("summary").alias("body")), after


def _guarded(provider: Callable[[str], str]) -> Callable[[str], str]:
    def call(text: str) -> str:
        try:
            return provider(text)
        except Exception as e:  # noqa: BLE001  a provider can fail in any way; the text says so
            return f"# Error summarizing batch\n\nCall failed: {e}\n"

    return call


def imported_sessions(messages: DataFrame, manifest: DataFrame, provider: Callable[[str], str], *, namespace: str, max_chars: int = 20_000, overlap: int = 2, most_batches: int = MAX_BATCHES) -> tuple[DataFrame, DataFrame]:
    """(session, batch, path, body) and the manifest (session, digest) after it, from messages of any format (session, pos, role, text,
    tools). Sessions whose digest the manifest has are skipped; of the others the first `most_batches` batches count."""
    found = stored(clipped_turns(turns(messages, "session", "pos", tools="tools").withColumn("session", F.col("session").cast("string"))), "turns")
    new = stored(changed(digests(found), manifest), "changed")
    fresh = found.join(new.select("session"), "session", "left_semi")
    split = batches(fresh, max_chars, overlap).where(F.col("batch") < most_batches)
    told = summaries(rendered(fresh, split, namespace), _guarded(provider))
    path = F.format_string(f"{namespace}/%s-batch-%02d.md", safe_key(F.col("session")), F.col("batch") + 1)
    after = manifest.select("session", "digest").join(new.select("session"), "session", "left_anti").unionByName(new.select("session", "digest"))
    return told.select("session", "batch", path.alias("path"), F.col("summary").alias("body")), after


def imported(memory: DataFrame, memory_manifest: DataFrame, messages: DataFrame, manifest: DataFrame, provider: Callable[[str], str] | None, *, namespace: str) -> dict[str, DataFrame]:
    """What an agent's import writes: memory files (path, hash, text) that the manifest (path, hash) has otherwise, and, with a provider,
    its sessions. documents (path, body), memory_manifest and session_manifest."""
    copied = changed_files(memory, memory_manifest)
    documents = copied.select(F.concat(F.lit(f"{namespace}-memory/"), "path").alias("path"), F.col("text").alias("body"))
    out = {"memory_manifest": memory.select("path", "hash"), "session_manifest": manifest}
    if provider is not None:
        told, out["session_manifest"] = imported_sessions(messages, manifest, provider, namespace=f"{namespace}-session")
        documents = documents.unionByName(told.select("path", "body"))
    return out | {"documents": documents}
