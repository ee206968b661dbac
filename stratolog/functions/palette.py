"""Colours that differ from each other."""

from __future__ import annotations

import colorsys
from collections.abc import Iterable

#: Fixed value: the golden ratio's fraction, which spreads hues evenly for any number of colours.
GOLDEN = 0.618033988749895


def _code(hue: float, light: float, saturation: float) -> str:
    red, green, blue = colorsys.hls_to_rgb(hue, light, saturation)
    return "#" + bytes(int(256 * min(x, 0.999)) for x in (red, green, blue)).hex()


def distinct_colors(n: int, lightness: float, saturation: float, offset: float = 0.0) -> list[str]:
    """n different colours: hues a golden section apart; a colour that is taken moves on in hue, then in lightness."""
    colors: list[str] = []
    for k in range(n):
        turn = 0
        while True:
            hue = (offset + k * GOLDEN + turn / 97) % 1.0
            light = lightness + (0.04 * (turn % 5) if turn else 0.0)
            color = _code(hue, min(light, 0.9), saturation)
            if color not in colors:
                break
            turn += 1
        colors.append(color)
    return colors


def fragment_colors(n: int) -> list[str]:
    return distinct_colors(n, 0.47, 0.72)


def type_colors(types: Iterable[str]) -> dict[str, str]:
    """A colour for each object type, by its place among the sorted types."""
    names = sorted(set(types))
    return dict(zip(names, distinct_colors(len(names), 0.68, 0.52, offset=0.08)))
