"""What can go wrong, as exceptions of one family."""


class CanopyError(Exception):
    pass


class InvalidPath(CanopyError, ValueError):
    """A path that is absolute, has '..', or isn't below the root."""


class InvalidRoot(CanopyError, ValueError):
    """The root isn't an existing directory."""


class InvalidSize(CanopyError, ValueError):
    """A byte size that can't be read, or a split size too small to make progress."""


class FormatError(CanopyError, ValueError):
    """A file that isn't in the record format, is cut short, or has an unknown record type."""


class ChecksumMismatch(FormatError):
    def __init__(self, stored: str, computed: str):
        super().__init__(f"checksum mismatch: the file says {stored}, its bytes give {computed}")


class VersionMismatch(FormatError):
    pass


class MissingChunk(CanopyError, FileNotFoundError):
    """No diff at the given place, or a gap in its chunks."""


class ContentMismatch(CanopyError, ValueError):
    """Content whose length or hash isn't that of its change."""


class VerificationFailed(CanopyError):
    def __init__(self, lines: int):
        super().__init__(f"{lines} discrepancies")
        self.lines = lines
