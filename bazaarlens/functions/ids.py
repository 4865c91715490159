"""Identity columns: content keys, keyed pseudonyms, 64-bit hash distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHA_BLOCK = 64


def idempotency_key(source: Column, chat: Column, keys: Column) -> Column:
    """sha256 over source, chat and the sorted distinct message keys, one per line."""
    listed = F.array_join(F.array_sort(F.array_distinct(keys)), "\n")
    return F.sha2(F.concat_ws("\n", source, chat, listed), 256)


def _pads(key: str) -> tuple[str, str]:
    if not key:
        raise ValueError("HMAC key is empty")
    raw = key.encode()
    if len(raw) > SHA_BLOCK:
        import hashlib
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(SHA_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 in hex, built from `sha2` so it stays in the JVM."""
    inner_pad, outer_pad = _pads(key)
    inner = F.sha2(F.concat(F.unhex(F.lit(inner_pad)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer_pad)), F.unhex(inner)), 256)


def pseudonym(prefix: str, raw_id: Column, key: str) -> Column:
    """A 32-character reference: case and device suffix (`:7@`) do not matter, the prefix separates domains."""
    plain = F.regexp_replace(F.lower(F.trim(raw_id)), r":\d+@", "@")
    return F.substring(hmac_sha256(F.concat(F.lit(prefix), plain), key), 1, 32)


def sender_ref(raw_id: Column, key: str) -> Column:
    return pseudonym("s:", raw_id, key)


def chat_ref(raw_id: Column, key: str) -> Column:
    return pseudonym("c:", raw_id, key)


def seen_key(remote: Column, message_id: Column, participant: Column) -> Column:
    joined = F.concat(remote, F.lit("|"), message_id, F.lit("|"), F.coalesce(participant, F.lit("")))
    return F.substring(F.sha2(joined, 256), 1, 24)


def log_mask(raw_id: Column, salt: str) -> Column:
    masked = F.concat(F.lit("u:"), F.substring(F.sha2(F.concat(F.lit(salt), raw_id), 256), 1, 8))
    return F.when(F.coalesce(raw_id, F.lit("")) == "", "u:none").otherwise(masked)


def occurrence_hash(chat: Column, header: Column, sender: Column, ident: Column, occurrence: Column) -> Column:
    joined = F.concat_ws("\u001f", chat, header, sender, ident, occurrence.cast("string"))
    return F.concat(F.lit("exp:"), F.substring(F.sha2(joined, 256), 1, 32))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def stable_order_hash(*parts: Column) -> Column:
    """A deterministic shuffle order."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
