"""Exceptions of the log, one per way an operation is refused."""


class LogError(Exception):
    """Base of all refusals."""


class Closed(LogError):
    """The log was closed before the operation; observers stay usable."""


class Full(LogError):
    """No room now; a commit can make room."""


class InvalidOffset(LogError):
    """The offset is beyond the head or was never reserved."""


class RecordTooLarge(LogError):
    """The record can never fit under the byte cap."""


class Corrupt(LogError):
    """Damaged data was dropped and stepped past."""


class CodecError(LogError):
    """The payload does not decode; the record stays at the head."""


class SegmentSizeMismatch(LogError):
    """The log was created with another segment size."""


class Locked(LogError):
    """Another writer holds the log."""


class IOFailed(LogError):
    """An earlier durability failure is latched; no further writes are accepted."""
