"""What can go wrong with a document. On executors these become the ``error`` column."""


class EvidenceError(Exception):
    """Base of the engine's errors."""


class UnsupportedFormat(EvidenceError):
    """No reader for this kind of file."""


class CorruptDocument(EvidenceError):
    """The file claims a format that its bytes do not hold."""


class ConversionFailed(EvidenceError):
    """An external converter gave no result."""


class MissingDependency(EvidenceError):
    """Something optional is not installed."""

    def __init__(self, what: str, hint: str) -> None:
        super().__init__(f"{what} is required. {hint}")
        self.what, self.hint = what, hint
