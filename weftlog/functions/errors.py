"""Errors of the event store: one class for each way a call can be refused."""

from __future__ import annotations


class WeftlogError(Exception):
    """Base of all errors of this package."""


class OptimisticConcurrencyError(WeftlogError):
    def __init__(self, stream_id: str, expected_version: int, actual_version: int) -> None:
        super().__init__(f'stream "{stream_id}" is at version {actual_version}, not at the expected {expected_version}')
        self.stream_id, self.expected_version, self.actual_version = stream_id, expected_version, actual_version


class StreamNotFoundError(WeftlogError):
    def __init__(self, stream_id: str) -> None:
        super().__init__(f'there is no stream "{stream_id}"')
        self.stream_id = stream_id


class CryptoKeyRevokedError(WeftlogError):
    def __init__(self, key_id: str) -> None:
        super().__init__(f'crypto key "{key_id}" is revoked; nothing more can be encrypted with it')
        self.key_id = key_id


class CryptoKeyNotFoundError(WeftlogError):
    def __init__(self, key_id: str) -> None:
        super().__init__(f'there is no crypto key "{key_id}"')
        self.key_id = key_id


class CryptoKeyIdRequiredError(WeftlogError):
    def __init__(self) -> None:
        super().__init__("an event with encrypted fields needs a crypto key id")


class CryptoSecretsRequiredError(WeftlogError):
    def __init__(self) -> None:
        super().__init__("crypto operations need versioned secrets, by argument or environment")


class InvalidCryptoSecretsError(WeftlogError):
    pass


class CryptoSecretVersionNotFoundError(WeftlogError):
    def __init__(self, version: int) -> None:
        super().__init__(f"crypto secret version {version} is not configured")
        self.version = version


class EventStoreNotInitializedError(WeftlogError):
    def __init__(self) -> None:
        super().__init__("the event store is not set up; call setup() first")


class InvalidSchemaNameError(WeftlogError):
    def __init__(self, schema_name: str) -> None:
        super().__init__(f'schema name "{schema_name}" must be 1 to 63 lower-case letters, digits or underscores, no digit first')
        self.schema_name = schema_name


class InvalidArgumentError(WeftlogError):
    def __init__(self, argument: str, reason: str) -> None:
        super().__init__(f'argument "{argument}" {reason}')
        self.argument, self.reason = argument, reason


class ReservedSnapshotEventTypeError(WeftlogError):
    def __init__(self, event_type: str) -> None:
        super().__init__(f'event type "{event_type}" is reserved: types ending in "Snapshot" belong to snapshots')
        self.event_type = event_type
