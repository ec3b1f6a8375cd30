"""A small move engine: legal moves, moves in short notation, positions as FEN.

Squares are numbered 0..63 from a8 to h1, as FEN lists them. Pure Python,
used only inside Arrow batches, one game or position at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
_LINES = {"r": ((0, 1), (0, -1), (1, 0), (-1, 0)), "b": ((1, 1), (1, -1), (-1, 1), (-1, -1))}
_LINES["q"] = _LINES["r"] + _LINES["b"]
_HOPS = {"n": ((1, 2), (1, -2), (-1, 2), (-1, -2), (2, 1), (2, -1), (-2, 1), (-2, -1)), "k": _LINES["q"]}


def _walk(square: int, steps: tuple) -> list[int]:
    r, c = divmod(square, 8)
    return [(r + a) * 8 + c + b for a, b in steps if 0 <= r + a < 8 and 0 <= c + b < 8]


def _ray(square: int, step: tuple[int, int]) -> list[int]:
    out, (r, c) = [], divmod(square, 8)
    while 0 <= (r := r + step[0]) < 8 and 0 <= (c := c + step[1]) < 8:
        out.append(r * 8 + c)
    return out


HOPS = {p: [_walk(s, d) for s in range(64)] for p, d in _HOPS.items()}
RAYS = {p: [[_ray(s, d) for d in dirs] for s in range(64)] for p, dirs in _LINES.items()}
#: Squares from which a pawn of the colour attacks the square.
PAWN_FROM = {"w": [_walk(s, ((1, -1), (1, 1))) for s in range(64)], "b": [_walk(s, ((-1, -1), (-1, 1))) for s in range(64)]}
#: Runs of empty squares in a FEN, the longest first.
_BLANKS = [(str(n), "." * n) for n in range(8, 0, -1)]
_CORNERS = {0: "q", 7: "k", 56: "Q", 63: "K"}
_SAN = re.compile(r"([KQRBN]?)([a-h]?)([1-8]?)[x-]?([a-h][1-8])(?:=?([QRBNqrbn]))?[+#]?\Z")


def square_name(s: int) -> str:
    return "abcdefgh"[s % 8] + "87654321"[s // 8]


def square_number(name: str) -> int:
    return "87654321".index(name[1]) * 8 + "abcdefgh".index(name[0])


class IllegalMove(ValueError):
    """A text that names no legal move of the position."""


@dataclass
class Position:
    board: list[str]
    white: bool = True
    rights: str = "KQkq"
    ep: int | None = None
    half: int = 0
    full: int = 1
    kings: dict[bool, int] = field(default_factory=dict)

    @classmethod
    def from_fen(cls, fen: str = START) -> Position:
        parts = fen.split()
        if len(parts) < 4:
            raise ValueError(f"a FEN has at least four fields: {fen!r}")
        board = [x for rank in parts[0].split("/") for y in rank for x in ("." * int(y) if y.isdigit() else y)]
        if len(board) != 64 or parts[1] not in "wb":
            raise ValueError(f"no sound position: {fen!r}")
        clock = lambda i, other: int(parts[i]) if len(parts) > i else other
        p = cls(board, parts[1] == "w", parts[2].strip("-"), None if parts[3] == "-" else square_number(parts[3]), clock(4, 0), clock(5, 1))
        p.kings = {c: board.index("K" if c else "k") for c in (True, False) if ("K" if c else "k") in board}
        return p

    def fen(self) -> str:
        """Six fields; the en-passant square only when such a capture is legal."""
        squares = "".join(self.board)
        placement = "/".join([squares[i : i + 8] for i in range(0, 64, 8)])
        for n, blank in _BLANKS:
            placement = placement.replace(blank, n)
        rights = "".join(x for x in "KQkq" if x in self.rights) or "-"
        ep = square_name(self.ep) if self.ep is not None and self._ep_is_legal() else "-"
        return f"{placement} {'w' if self.white else 'b'} {rights} {ep} {self.half} {self.full}"

    def attacked(self, square: int, by_white: bool) -> bool:
        b = self.board
        pawn, knight, king, rook, bishop, queen = "PNKRBQ" if by_white else "pnkrbq"
        for piece, spots in ((pawn, PAWN_FROM["w" if by_white else "b"][square]), (knight, HOPS["n"][square]), (king, HOPS["k"][square])):
            for s in spots:
                if b[s] == piece:
                    return True
        for slider, rays in ((rook, RAYS["r"][square]), (bishop, RAYS["b"][square])):
            for ray in rays:
                for s in ray:
                    x = b[s]
                    if x != ".":
                        if x == slider or x == queen:
                            return True
                        break
        return False

    def _after(self, move: tuple[int, int, str]) -> Position:
        """The position after a move (from, to, promotion letter or ''), legal or not."""
        a, z, promotion = move
        b, piece, half = self.board[:], self.board[a], self.half + 1
        kind = piece.lower()
        if kind == "p" or b[z] != ".":
            half = 0
        ep = None
        b[z], b[a] = piece, "."
        kings = self.kings
        if kind == "p":
            if z == self.ep and a % 8 != z % 8:
                b[z + (8 if self.white else -8)] = "."
            if abs(a - z) == 16:
                ep = (a + z) // 2
            if promotion:
                b[z] = promotion.upper() if self.white else promotion.lower()
        elif kind == "k":
            kings = kings | {self.white: z}
            if abs(a - z) == 2:
                rook, to = (z + 1, z - 1) if z > a else (z - 2, z + 1)
                b[to], b[rook] = b[rook], "."
        rights = self.rights
        if rights and (kind == "k" or a in _CORNERS or z in _CORNERS):
            lost = ("KQ" if self.white else "kq") if kind == "k" else ""
            lost += "".join(_CORNERS[s] for s in (a, z) if s in _CORNERS)
            rights = "".join(x for x in rights if x not in lost)
        return Position(b, not self.white, rights, ep, half, self.full + (not self.white), kings)

    def _safe(self, move: tuple[int, int, str]) -> bool:
        after = self._after(move)
        king = after.kings.get(self.white)
        return king is None or not after.attacked(king, not self.white)

    def _ep_is_legal(self) -> bool:
        pawn = "P" if self.white else "p"
        return any(self.board[s] == pawn and self._safe((s, self.ep, "")) for s in PAWN_FROM["w" if self.white else "b"][self.ep])

    def _own(self, piece: str) -> bool:
        return piece != "." and piece.isupper() == self.white

    def _pawn_moves(self, a: int):
        b, ahead = self.board, (-8 if self.white else 8)
        spots = []
        if 0 <= a + ahead < 64 and b[a + ahead] == ".":
            spots.append(a + ahead)
            if a // 8 == (6 if self.white else 1) and b[a + 2 * ahead] == ".":
                spots.append(a + 2 * ahead)
        for z in PAWN_FROM["b" if self.white else "w"][a]:  # what a pawn attacks is where one of the other colour attacks it from
            if z == self.ep or (b[z] != "." and not self._own(b[z])):
                spots.append(z)
        for z in spots:
            for promotion in "qrbn" if z // 8 in (0, 7) else ("",):
                yield a, z, promotion

    def _castlings(self):
        king = 60 if self.white else 4
        if self.kings.get(self.white) != king or self.attacked(king, not self.white):
            return
        k, q = ("K", "Q") if self.white else ("k", "q")
        b, rook = self.board, "R" if self.white else "r"
        if k in self.rights and b[king + 1] == b[king + 2] == "." and b[king + 3] == rook and not self.attacked(king + 1, not self.white):
            yield king, king + 2, ""
        if q in self.rights and b[king - 1] == b[king - 2] == b[king - 3] == "." and b[king - 4] == rook and not self.attacked(king - 1, not self.white):
            yield king, king - 2, ""

    def _reach(self, a: int):
        kind = self.board[a].lower()
        if kind in HOPS:
            yield from (s for s in HOPS[kind][a] if not self._own(self.board[s]))
        else:
            for ray in RAYS[kind][a]:
                for s in ray:
                    if not self._own(self.board[s]):
                        yield s
                    if self.board[s] != ".":
                        break

    def legal_moves(self) -> list[tuple[int, int, str]]:
        found = []
        for a, piece in enumerate(self.board):
            if self._own(piece):
                found += self._pawn_moves(a) if piece in "Pp" else [(a, z, "") for z in self._reach(a)]
        return [m for m in found if self._safe(m)] + [m for m in self._castlings() if self._safe(m)]

    def move_of(self, san: str) -> tuple[int, int, str]:
        """The one legal move that a text in short (or fuller) notation names."""
        text = san.rstrip("+#!?")
        if text in ("O-O", "0-0", "O-O-O", "0-0-0"):
            wanted = 2 if len(text) == 3 else -2
            found = [m for m in self._castlings() if m[1] - m[0] == wanted and self._safe(m)]
        else:
            m = _SAN.match(text)
            if not m:
                raise IllegalMove(san)
            kind, column, rank, target, promotion = m.groups()
            z, kind = square_number(target), (kind or "p").lower()
            piece = kind.upper() if self.white else kind
            found = []
            for a, x in enumerate(self.board):
                if x != piece or (column and "abcdefgh"[a % 8] != column) or (rank and "87654321"[a // 8] != rank):
                    continue
                options = self._pawn_moves(a) if kind == "p" else ((a, s, "") for s in self._reach(a))
                found += [o for o in options if o[1] == z and o[2] == (promotion or "").lower() and self._safe(o)]
        if len(found) != 1:
            raise IllegalMove(san)
        return found[0]

    def push(self, move: tuple[int, int, str]) -> Position:
        return self._after(move)
