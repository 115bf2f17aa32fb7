"""Physical schemas of the log and its support tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: Bytes of an initialisation vector, an authentication tag and a key of AES-256-GCM.
IV, TAG, KEY = 12, 16, 32

ENCRYPTED = "map<string, struct<version:bigint, ciphertext:string, iv:string, auth_tag:string>>"

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}


def _struct(text: str) -> T.StructType:
    """A schema of simple types from "name type, ...": unlike DDL, without a session."""
    pairs = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


_FIELD = T.StructType(_struct("version long, ciphertext string, iv string, auth_tag string").fields)

#: Rows of the log: a CloudEvents envelope and the store's own fields. ``txid`` is the commit that appended the row.
LOG = T.StructType(
    [
        *_struct(
            """global_position long, stream_id string, stream_version int, id string, source string, specversion string, event_type string,
            subject string, time timestamp, datacontenttype string, data string, extensions string"""
        ).fields,
        T.StructField("encrypted_data", T.MapType(T.StringType(), _FIELD)),
        *_struct("crypto_key_id string, schema_version int, created_at timestamp, txid long").fields,
    ]
)

#: What subscriptions and projections see: clean data, neither decrypted nor upcast.
EVENT_COLUMNS = [
    "global_position", "stream_id", "stream_version", "id", "source", "specversion", "event_type", "subject", "time",
    "datacontenttype", "data", "extensions", "created_at",
]
#: What reads by stream see, before decryption and upcasting.
REPLAY_COLUMNS = [*EVENT_COLUMNS[:-1], "encrypted_data", "crypto_key_id", "schema_version", "created_at"]

OUTBOX = _struct("id long, event_global_pos long, topic string, payload string, created_at timestamp")
HEADS = _struct("stream_id string, version int")
ACKS = _struct("id long, processed_at timestamp")
CRYPTO_KEYS = _struct("key_id string, encrypted_key binary, algorithm string, revoked_at timestamp, created_at timestamp")

SPECVERSION = "1.0"
CONTENT_TYPE = "application/json"
DEFAULT_SOURCE = "event-store"
