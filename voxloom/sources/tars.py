"""Samples out of a stream of tar bytes that may begin anywhere.

A stream that begins inside a tar is brought into step at the next header whose checksum is right. Members are kept with
the extension headers before them. Adjacent members of one key are a sample; where the stream began before the first
one, its key cannot be told from the one before, so all bytes up to the first sure change of key are the ``lead``.

A member whose own data is an uncompressed tar looks like more of the archive to a stream that begins inside it: such
archives must be read from their start.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

BLOCK = tarfile.BLOCKSIZE
MAGIC = b"ustar"
MAGIC_AT = 257
EXTENSIONS = (tarfile.XHDTYPE, tarfile.XGLTYPE, tarfile.SOLARIS_XHDTYPE, tarfile.GNUTYPE_LONGNAME, tarfile.GNUTYPE_LONGLINK)
ZEROS = bytes(BLOCK)


def header(block: bytes) -> tarfile.TarInfo | None:
    """The header in a block, if it is one."""
    try:
        return tarfile.TarInfo.frombuf(block, tarfile.ENCODING, "surrogateescape")
    except tarfile.HeaderError:
        return None


def _padded(size: int) -> int:
    return -(-size // BLOCK) * BLOCK


def _data_size(info: tarfile.TarInfo) -> int:
    has_data = info.isreg() or info.type not in tarfile.SUPPORTED_TYPES or info.type in EXTENSIONS
    return _padded(info.size) if has_data else 0


def sample_name(name: str) -> tuple[str, str] | None:
    """Key and extension of a member: the extension is all after the first dot of the file name, in lower case."""
    folder, _, base = name.rpartition("/")
    stem, dot, ext = base.partition(".")
    if not dot or not stem:
        return None
    return (f"{folder}/{stem}" if folder else stem), ext.lower()


def member_bytes(name: str, data: bytes) -> tuple[bytes, bytes]:
    """Header blocks of a member, and its data with the padding to whole blocks."""
    info = tarfile.TarInfo(name)
    info.size = len(data)
    return info.tobuf(tarfile.PAX_FORMAT), data + bytes(_padded(len(data)) - len(data))


class TarSamples:
    """Feed bytes, get the samples that are complete. Offsets count from the first byte fed."""

    def __init__(self, at_header: bool, limit: int | None = None):
        self.held = bytearray()
        self.base = 0  # offset of the first byte held
        self.place: int | None = 0 if at_header else None  # next header, in what is held
        self.searched = 0
        self.lead: bytes | None = b"" if at_header else None
        self.unsure = not at_header  # the first member may lack its extension headers
        self.key: str | None = None
        self.begin = 0  # offset of the first own header of the sample
        self.members: dict[str, bytes] = {}
        self.limit = limit
        self.beyond: list[int] = []  # offsets of the first two members' own headers at or beyond the limit
        self.ended = False

    def feed(self, piece: bytes) -> Iterator[tuple[int, str, dict[str, bytes]]]:
        """(offset of its first header, key, members) of each sample that the bytes complete."""
        self.held += piece
        if self.place is None:
            self._find()
        while self.place is not None and not self.ended:
            found = self._member()
            if found is None:
                return
            own, end, name, data = found
            if self.unsure:
                self.unsure = False
            elif name is not None and (named := sample_name(name)) is not None:
                key, ext = named
                if key != self.key:
                    if self.key is not None and self.lead is not None:
                        yield self.begin, self.key, self.members
                    if self.key is not None and self.lead is None:
                        self.lead = bytes(self.held[: self.place])
                    if self.lead is not None:
                        own, end = own - self.place, end - self.place
                        self.base += self.place
                        del self.held[: self.place]
                    self.key, self.begin, self.members = key, self.base + own, {}
                self.members[ext] = data
            self.place = end

    def finish(self) -> Iterator[tuple[int, str, dict[str, bytes]]]:
        """The last sample, at the end of the archive."""
        if not self.ended and self.place is not None and self.place < len(self.held):
            raise ValueError("the tar ends inside a member")
        if self.key is not None and self.lead is not None:
            yield self.begin, self.key, self.members

    def _find(self) -> None:
        """The next header by its checksum."""
        while (at := self.held.find(MAGIC, self.searched)) >= 0:
            start = at - MAGIC_AT
            if start >= 0 and len(self.held) < start + BLOCK:
                return
            if start >= 0 and header(bytes(self.held[start : start + BLOCK])):
                self.place = start
                return
            self.searched = at + 1
        self.searched = max(self.searched, len(self.held) - len(MAGIC) + 1)

    def _member(self) -> tuple[int, int, str | None, bytes] | None:
        """(own header, end, name, data) of the next member; the name is None for what is no file. None if it is not all there."""
        at, extended = self.place, False
        while True:
            block = bytes(self.held[at : at + BLOCK])
            if len(block) < BLOCK:
                return None
            if block == ZEROS:
                self.ended = True
                return None
            info = header(block)
            if info is None:
                raise ValueError(f"no tar header at byte {self.base + at}")
            end = at + BLOCK + _data_size(info)
            if info.type not in EXTENSIONS:
                break
            at, extended = end, True
        if len(self.held) < end:
            return None
        if self.limit is not None and self.base + at >= self.limit and len(self.beyond) < 2:
            self.beyond.append(self.base + at)
        if extended:
            with tarfile.open(fileobj=io.BytesIO(self.held[self.place : end]), mode="r:") as tar:
                member = tar.next()
                data = tar.extractfile(member).read() if member.isfile() else b""
                return at, end, member.name if member.isfile() else None, data
        data = bytes(self.held[at + BLOCK : at + BLOCK + info.size]) if info.isfile() else b""
        return at, end, info.name if info.isfile() else None, data
