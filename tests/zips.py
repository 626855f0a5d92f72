"""ZIP bytes for tests."""

from tidemark.sources.synthetic import make, tlv, unicode_path  # noqa: F401
