"""Crypto-shredding as plans: authenticated field encryption, decryption and replay of whole logs.

Nothing is done row by row on the driver. Keys come as a table (key_id, key, revoked), see
:meth:`weftlog.operators.keyring.KeyRing.opened`, and are joined by id, so that a log of any number of keys is read in one plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.functions import codecs
from weftlog.functions.validation import encrypted_paths
from weftlog.operators.upcasts import Upcasters
from weftlog.sources.schema import ENCRYPTED, IV, TAG

FIELD_DOMAIN = "weftlog:event-field:v2"


def field_aad(event_id: Column, key_id: Column, path: Column, version: Column) -> Column:
    """What an encrypted field is bound to: moved to another event, key, path or version, it does not open."""
    return codecs.bound(F.lit(FIELD_DOMAIN), event_id, key_id, path, version.cast("string"))


def outcome(encrypted: Column, revoked: Column) -> Column:
    """plain, decrypted or tombstone: ``revoked`` is null where there is no such key (or no secrets at all)."""
    return F.when(~encrypted, "plain").when(F.coalesce(revoked, F.lit(True)), "tombstone").otherwise("decrypted")


def sealed(plain: Column, key: Column, aad: Column) -> Column:
    """iv, ciphertext and tag of a value under AES-GCM, with a random iv."""
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), aad)


def opened(raw: Column, key: Column, aad: Column) -> Column:
    """The plain bytes of :func:`sealed`; an error if key, tag or context do not fit."""
    return F.aes_decrypt(raw, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def _with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (id, crypto_key_id, ...) with _key and _r of their key, null where there is none.

    Rows without a key id are mostly the larger part of a log. They meet no key, but under the id that they lack all of them would
    go to one task: they are spread by their own.
    """
    known = keys.select(F.col("key_id").alias("_k"), F.col("key").alias("_key"), F.col("revoked").alias("_r"))
    keyed = F.col("crypto_key_id").isNotNull()
    return rows.join(known, (F.coalesce("crypto_key_id", "id") == F.col("_k")) & keyed, "left").drop("_k")


def encrypt(rows: DataFrame, fields: Mapping[str, Sequence[str]], keys: DataFrame, version: int) -> DataFrame:
    """``rows`` (id, event_type, data JSON, crypto_key_id, ...) with the fields of their type taken out of data and encrypted.

    Adds encrypted_data, null for types without fields (their crypto_key_id becomes null too) and an empty map where none
    of the fields is there. ``keys``: (key_id, key binary, revoked) of every id that is used; ``version``: of the secret
    that wraps them. A row whose key is missing or revoked fails the plan.
    """
    for paths in fields.values():
        encrypted_paths(paths)
    own = F.col("event_type").isin([k for k, paths in fields.items() if paths]) if any(fields.values()) else F.lit(False)
    marked = rows.withColumn("crypto_key_id", F.when(own, F.col("crypto_key_id")))
    met = _with_keys(marked, keys)
    wrong = (
        F.when(~own, F.lit(None).cast("string"))
        .when(F.col("crypto_key_id").isNull(), F.lit("an event with encrypted fields needs a crypto key id"))
        .when(F.col("_r").isNull(), F.concat(F.lit("there is no crypto key "), "crypto_key_id"))
        .when(F.col("_r"), F.concat(F.lit("revoked crypto key "), "crypto_key_id"))
    )
    met = met.withColumn("_key", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("binary")).otherwise(F.col("_key")))
    named = {(k, path): n for n, (k, path) in enumerate((k, path) for k, paths in fields.items() for path in paths)}
    met = met.withColumns({f"_v{n}": F.when(F.col("event_type") == k, codecs.json_get(F.col("data"), path)) for (k, path), n in named.items()})

    def boxed(n: int, path: str) -> Column:
        """The entry of one field. The ciphertext is an element of an array, whose parts are all of one sealing with one iv."""
        raw = sealed(F.col(f"_v{n}").cast("binary"), F.col("_key"), field_aad(F.col("id"), F.col("crypto_key_id"), F.lit(path), F.lit(version)))
        parts = lambda r: (F.substring(r, IV + 1, F.octet_length(r) - IV - TAG), F.substring(r, 1, IV), F.substring(r, F.octet_length(r) - TAG + 1, F.lit(TAG)))
        entry = lambda r: F.struct(F.lit(version).cast("long").alias("version"), *(F.base64(x).alias(k) for x, k in zip(parts(r), ("ciphertext", "iv", "auth_tag"))))
        return F.when(F.col(f"_v{n}").isNotNull(), F.transform(F.array(raw), entry)[0])

    met = met.withColumns({f"_b{n}": boxed(n, path) for (_, path), n in named.items()})
    data, boxes = F.col("data"), F.lit(None).cast(ENCRYPTED)
    for kind, paths in fields.items():
        if not paths:
            continue
        hit, clean, found = F.col("event_type") == kind, F.col("data"), []
        for path in paths:
            found.append(F.struct(F.lit(path).alias("key"), F.col(f"_b{named[kind, path]}").alias("value")))
            clean = codecs.json_delete(clean, path)
        held = F.map_from_entries(F.filter(F.array(*found), lambda e: e["value"].isNotNull())).cast(ENCRYPTED)
        data, boxes = F.when(hit, clean).otherwise(data), F.when(hit, held).otherwise(boxes)
    # The key is looked at for every row of these types, so that a missing one is refused even where no field is there.
    checked = F.when(own & F.col("_key").isNull(), F.raise_error(F.lit("the material of a crypto key is missing")).cast("string")).otherwise(data)
    return met.withColumns({"data": checked, "encrypted_data": boxes}).select(*rows.columns, *(["encrypted_data"] if "encrypted_data" not in rows.columns else []))


def _paths(encrypted: Column) -> Column:
    return F.array_sort(F.map_keys(encrypted))


def decrypt(log: DataFrame, keys: DataFrame | None) -> DataFrame:
    """``log`` with data as it was before encryption, and ``tombstoned``: true, and data null, where the key is missing or revoked.

    ``keys``: (key_id, key binary, revoked), or None without secrets, so that every encrypted event is a tombstone. Fields come
    back by their stored paths, whatever they are; ciphertexts, ivs and tags that do not fit fail the plan.
    """
    if keys is None:
        met = log.withColumns({"_key": F.lit(None).cast("binary"), "_r": F.lit(None).cast("boolean")})
    else:
        met = _with_keys(log, keys)
    encrypted = F.col("encrypted_data").isNotNull() & F.col("crypto_key_id").isNotNull()
    kind = outcome(encrypted, F.col("_r"))

    def merged(data: Column, path: Column) -> Column:
        e = F.element_at("encrypted_data", path)
        raw = F.concat(codecs.unbase64_strict(e["iv"], IV), codecs.unbase64_strict(e["ciphertext"]), codecs.unbase64_strict(e["auth_tag"], TAG))
        aad = field_aad(F.col("id"), F.col("crypto_key_id"), path, e["version"])
        return codecs.json_set(data, path, opened(raw, F.col("_key"), aad).cast("string"))

    data = F.when(kind == "plain", F.col("data")).when(kind == "decrypted", F.aggregate(_paths(F.col("encrypted_data")), F.col("data"), merged))
    return met.withColumns({"data": data, "tombstoned": kind == "tombstone"}).drop("_key", "_r")


def replayed(log: DataFrame, keys: DataFrame | None, upcasters: Upcasters | None = None) -> DataFrame:
    """``log`` as a reader of streams gets it: decrypted, then upcast (functions of JSON columns); tombstones are neither."""
    out = decrypt(log, keys)
    return out if upcasters is None else out.withColumn("data", upcasters.column(F.col("data")))
