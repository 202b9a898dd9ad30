"""Binary traces: metadata text, field layout, reading and writing."""

from .reader import packet_index, read_ctf, trace_infos  # noqa: F401
from .tsdl import parse_metadata  # noqa: F401
