"""Versioned secrets, and entity keys wrapped by them.

An envelope of a key is: magic, secret version, iv, tag, ciphertext. AES-GCM runs in Spark's own expressions, so that no other
library is needed; secrets and keys enter plans as rows of small frames, never as literals that a plan would print.
"""

from __future__ import annotations

import hashlib
import json
import os
import secrets
from base64 import b64encode
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.functions import codecs, errors
from weftlog.functions.codecs import bound_value, delete_path, get_path, set_path, strict_base64, uint32
from weftlog.functions.validation import encrypted_paths
from weftlog.operators import crypto
from weftlog.operators.crypto import FIELD_DOMAIN
from weftlog.sources.schema import IV, KEY, TAG

MAGIC = b"WFL2"
KEY_DOMAIN = "weftlog:entity-key:v2"
SALT = b"weftlog:secret:v1"
_HEADER = len(MAGIC) + 4
ENVELOPE = _HEADER + IV + TAG + KEY
ALGORITHM = "AES-256-GCM"


@dataclass(frozen=True)
class Secrets:
    """Secret values by version, and the version that new envelopes use."""

    current: int
    values: Mapping[int, str]

    def __post_init__(self) -> None:
        for version in [self.current, *self.values]:
            if not isinstance(version, int) or isinstance(version, bool) or not 0 <= version < 2**32:
                raise errors.InvalidCryptoSecretsError(f"secret version {version!r} is not an unsigned 32-bit number")
        if not self.values or any(not isinstance(v, str) or not v for v in self.values.values()):
            raise errors.InvalidCryptoSecretsError("secrets must be non-empty strings, one at least")
        if self.current not in self.values:
            raise errors.InvalidCryptoSecretsError(f"the current version {self.current} is not among the secrets")

    @classmethod
    def of(cls, current_version: int, pairs: Sequence[tuple[int, str]]) -> Secrets:
        if len({v for v, _ in pairs}) != len(pairs):
            raise errors.InvalidCryptoSecretsError("a secret version is given twice")
        return cls(current_version, dict(pairs))

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None) -> Secrets | None:
        """From GDPR_CRYPTO_SECRETS ("version:value,...") and GDPR_CRYPTO_CURRENT_VERSION; None if neither is set."""
        env = os.environ if env is None else env
        listed, current = env.get("GDPR_CRYPTO_SECRETS"), env.get("GDPR_CRYPTO_CURRENT_VERSION")
        if not listed and not current:
            return None
        if not listed or not current:
            raise errors.InvalidCryptoSecretsError("GDPR_CRYPTO_SECRETS and GDPR_CRYPTO_CURRENT_VERSION go together")
        pairs = []
        for part in listed.split(","):
            version, colon, value = part.strip().partition(":")
            if not colon or not version.isdecimal():
                raise errors.InvalidCryptoSecretsError("GDPR_CRYPTO_SECRETS must be version:value pairs")
            pairs.append((int(version), value))
        if not current.strip().isdecimal():
            raise errors.InvalidCryptoSecretsError("GDPR_CRYPTO_CURRENT_VERSION must be a number")
        return cls.of(int(current), pairs)


class Sealer:
    """AES-256-GCM of many values in one plan."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _rows(self, rows: Sequence[tuple[bytes, ...]], names: Sequence[str]) -> DataFrame:
        numbered = [(k, *map(bytearray, r)) for k, r in enumerate(rows)]
        return self.spark.createDataFrame(numbered, "k int, " + ", ".join(f"{n} binary" for n in names)).coalesce(1)

    def seal(self, values: Sequence[tuple[bytes, bytes, bytes]]) -> list[tuple[bytes, bytes, bytes]]:
        """(iv, tag, ciphertext), with a random iv, of each (key, plain, context)."""
        if not values:
            return []
        rows = self._rows(values, ("key", "plain", "aad")).select("k", crypto.sealed(F.col("plain"), F.col("key"), F.col("aad")).alias("x")).collect()
        raw = [bytes(r.x) for r in sorted(rows, key=lambda r: r.k)]
        return [(x[:IV], x[-TAG:], x[IV:-TAG]) for x in raw]

    def open(self, values: Sequence[tuple[bytes, bytes, bytes, bytes, bytes]]) -> list[bytes]:
        """The plain bytes of each (key, iv, tag, ciphertext, context); ValueError if one's key, tag or context do not fit."""
        if not values:
            return []
        rows = self._rows([(key, iv + cipher + tag, aad) for key, iv, tag, cipher, aad in values], ("key", "raw", "aad"))
        plain = F.try_aes_decrypt("raw", "key", F.lit("GCM"), F.lit("DEFAULT"), "aad")
        found = sorted(rows.select("k", plain.alias("x")).collect(), key=lambda r: r.k)
        if any(r.x is None for r in found):
            raise ValueError("authentication failed")
        return [bytes(r.x) for r in found]


class KeyRing:
    """Entity keys as rows of the log's table of keys: (key_id, encrypted_key, algorithm, revoked_at, created_at)."""

    def __init__(self, sealer: Sealer, given: Secrets) -> None:
        self.sealer, self.given = sealer, given
        self._secret = {v: hashlib.scrypt(s.encode(), salt=SALT, n=16384, r=8, p=1, maxmem=64 * 2**20, dklen=KEY) for v, s in given.values.items()}

    # Plans.

    def opened(self, keys: DataFrame) -> DataFrame:
        """(key_id, key binary, revoked, version long) of a table of keys, unwrapped in one plan; key is null where it is revoked.

        A missing or broken envelope, or one of a secret that is not configured, fails the plan.
        """
        spark, env = self.sealer.spark, F.col("encrypted_key")
        known = spark.createDataFrame([(v, bytearray(s)) for v, s in self._secret.items()], "_version long, _secret binary")
        rows = keys.withColumn("version", codecs.read_uint32(env, len(MAGIC) + 1)).join(F.broadcast(known), F.col("version") == F.col("_version"), "left")
        revoked = F.col("revoked_at").isNotNull()
        named = lambda text: F.concat(F.lit(text), "key_id")
        wrong = (
            F.when(env.isNull(), named("the material is missing of crypto key "))
            .when((F.octet_length(env) != ENVELOPE) | (F.substring(env, 1, len(MAGIC)) != F.lit(MAGIC)), named("not a key envelope: "))
            .when(F.col("_secret").isNull(), F.concat(F.lit("crypto secret version "), F.col("version").cast("string"), F.lit(" is not configured")))
        )
        raw = F.concat(F.substring(env, _HEADER + 1, IV), F.substring(env, _HEADER + IV + TAG + 1, KEY), F.substring(env, _HEADER + IV + 1, TAG))
        aad = codecs.bound(F.lit(KEY_DOMAIN), F.col("key_id"), F.base64(F.substring(env, 1, _HEADER)))
        key = F.when(revoked, F.lit(None).cast("binary")).when(wrong.isNotNull(), F.raise_error(wrong).cast("binary")).otherwise(crypto.opened(raw, F.col("_secret"), aad))
        return rows.select("key_id", key.alias("key"), revoked.alias("revoked"), "version")

    def wrapped(self, keys: DataFrame) -> DataFrame:
        """Rows of the table of keys, anew, for (key_id, key binary, created_at): by the current secret, in one plan."""
        header, current = MAGIC + uint32(self.given.current), self.given.current
        secret = self.sealer.spark.createDataFrame([(current, bytearray(self._secret[current]))], "_version long, _secret binary")
        aad = codecs.bound(F.lit(KEY_DOMAIN), F.col("key_id"), F.lit(b64encode(header).decode()))
        raw = keys.withColumn("_version", F.lit(current).cast("long")).join(F.broadcast(secret), "_version").withColumn("_raw", crypto.sealed(F.col("key"), F.col("_secret"), aad))
        box = F.concat(F.lit(header), F.substring("_raw", 1, IV), F.substring("_raw", IV + KEY + 1, TAG), F.substring("_raw", IV + 1, KEY))
        return raw.select("key_id", box.alias("encrypted_key"), F.lit(ALGORITHM).alias("algorithm"), F.lit(None).cast("timestamp").alias("revoked_at"), "created_at")

    # Values.

    @staticmethod
    def _aad(header: bytes, key_id: str) -> bytes:
        return bound_value(KEY_DOMAIN, key_id, b64encode(header).decode())

    def wrap(self, keys: Mapping[str, bytes]) -> dict[str, bytes]:
        header = MAGIC + uint32(self.given.current)
        boxes = self.sealer.seal([(self._secret[self.given.current], key, self._aad(header, key_id)) for key_id, key in keys.items()])
        return {key_id: header + iv + tag + cipher for key_id, (iv, tag, cipher) in zip(keys, boxes)}

    def new_rows(self, key_ids: Sequence[str]) -> dict[str, dict[str, Any]]:
        boxes = self.wrap({k: secrets.token_bytes(KEY) for k in key_ids})
        return {k: {"encrypted_key": b, "algorithm": ALGORITHM, "revoked_at": None, "created_at": _now()} for k, b in boxes.items()}

    @staticmethod
    def revoked_row(row: Mapping[str, Any]) -> dict[str, Any]:
        return {**row, "encrypted_key": None, "revoked_at": row["revoked_at"] or _now()}

    def version(self, row: Mapping[str, Any], key_id: str) -> int:
        """The secret version of a row's envelope, which must be whole and of a configured secret."""
        envelope = row["encrypted_key"]
        if envelope is None:
            raise ValueError(f'the material of crypto key "{key_id}" is missing')
        if len(envelope) != ENVELOPE or bytes(envelope[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a key envelope")
        version = int.from_bytes(envelope[len(MAGIC) : _HEADER], "big")
        if version not in self._secret:
            raise errors.CryptoSecretVersionNotFoundError(version)
        return version

    def unwrap(self, rows: Mapping[str, Mapping[str, Any]]) -> dict[str, bytes]:
        """The keys of rows that are not revoked, in one plan."""
        values = []
        for key_id, row in rows.items():
            secret, e = self._secret[self.version(row, key_id)], bytes(row["encrypted_key"])
            rest = e[_HEADER:]
            values.append((secret, rest[:IV], rest[IV : IV + TAG], rest[IV + TAG :], self._aad(e[:_HEADER], key_id)))
        return dict(zip(rows, self.sealer.open(values)))

    def for_reading(self, rows: Mapping[str, Mapping[str, Any] | None]) -> dict[str, bytes | None]:
        """The key of each id; None if it is revoked or there is none, so that its events are tombstones."""
        live = {k: r for k, r in rows.items() if r is not None and r["revoked_at"] is None}
        return {k: None for k in rows} | self.unwrap(live)

    def for_writing(self, rows: Mapping[str, Mapping[str, Any] | None]) -> tuple[dict[str, bytes], dict[str, dict[str, Any]]]:
        """The keys, and the rows wrapped anew of those whose secret is older than the current one (never if newer)."""
        for key_id, row in rows.items():
            if row is None:
                raise errors.CryptoKeyNotFoundError(key_id)
            if row["revoked_at"] is not None:
                raise errors.CryptoKeyRevokedError(key_id)
        keys = self.unwrap(rows)
        old = {k: keys[k] for k, r in rows.items() if self.version(r, k) < self.given.current}
        return keys, {k: {**rows[k], "encrypted_key": b} for k, b in self.wrap(old).items()}

    @staticmethod
    def _context(event_id: str, key_id: str, path: str, version: int) -> bytes:
        return bound_value(FIELD_DOMAIN, event_id, key_id, path, str(version))

    def encrypt_fields(self, events: Sequence[tuple[Any, Sequence[str], bytes, str, str]]) -> list[tuple[Any, dict[str, dict[str, Any]]]]:
        """(clean data, entries by path) of each (data, fields, key, event id, key id), in one plan: absent fields are skipped."""
        version, found, values = self.given.current, [], []
        for data, fields, key, event_id, key_id in events:
            encrypted_paths(fields)
            held = {path: value for path in fields for there, value in [get_path(data, path)] if there}
            found.append(list(held))
            values += [(key, json.dumps(v, ensure_ascii=False).encode(), self._context(event_id, key_id, path, version)) for path, v in held.items()]
        boxes, out = iter(self.sealer.seal(values)), []
        for (data, *_), paths in zip(events, found):
            entries = {}
            for path in paths:
                iv, tag, cipher = (b64encode(x).decode() for x in next(boxes))
                entries[path] = {"version": version, "ciphertext": cipher, "iv": iv, "auth_tag": tag}
                data = delete_path(data, path)
            out.append((data, entries))
        return out

    def decrypt_fields(self, events: Sequence[tuple[Any, Mapping[str, Mapping[str, Any]], bytes, str, str]]) -> list[Any]:
        """Whole data of each (data, entries, key, event id, key id), in one plan."""
        values = [
            (key, strict_base64(e["iv"], IV), strict_base64(e["auth_tag"], TAG), strict_base64(e["ciphertext"]), self._context(event_id, key_id, path, e["version"]))
            for _, entries, key, event_id, key_id in events for path, e in entries.items()
        ]
        plain, out = iter(self.sealer.open(values)), []
        for data, entries, *_ in events:
            for path in entries:
                data = set_path(data, path, json.loads(next(plain)))
            out.append(data)
        return out


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)
