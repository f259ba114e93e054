"""Plain values of the driver: schedules, grids, text for reports."""

from __future__ import annotations

import math


def learning_rate(epoch: int, epochs: int, first: float, peak: float, last: float) -> float:
    """40 % of the epochs up from ``first`` to ``peak``, 40 % back, 20 % from ``first`` to ``last``, in straight lines."""
    at = epoch / max(1, epochs - 1)
    if at <= 0.4:
        return first + (peak - first) * at / 0.4
    if at <= 0.8:
        return peak + (first - peak) * (at - 0.4) / 0.4
    return first + (last - first) * (at - 0.8) / 0.2


def parse_grid(text: str) -> tuple[int, ...]:
    """Whole numbers "a,b,c" of 2 or more, sorted, each once."""
    values = tuple(sorted({int(t) for t in str(text).split(",")}))
    if values[0] < 2:
        raise ValueError("a grid holds numbers of 2 or more")
    return values


#: What LaTeX reads as commands, and how it prints them.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex_text(value: object) -> str:
    """Text in which LaTeX reads no command."""
    return "".join(LATEX.get(c, c) for c in str(value))


def number_text(value: float | None, digits: int = 4) -> str:
    """A number of so many significant digits; a dash for none, words for what is not finite."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "--"
    if isinstance(value, float) and math.isinf(value):
        return r"$\infty$" if value > 0 else r"$-\infty$"
    return str(value) if isinstance(value, int) else f"{value:.{digits}g}"


def latex_table(columns: list[str], rows: list[tuple], digits: int = 4) -> str:
    """A LaTeX table of plain rows."""
    cell = lambda v: latex_text(v) if isinstance(v, str) else number_text(v, digits)
    lines = [r"\begin{tabular}{" + "l" * len(columns) + "}", " & ".join(map(latex_text, columns)) + r" \\ \hline"]
    return "\n".join([*lines, *(" & ".join(map(cell, r)) + r" \\" for r in rows), r"\end{tabular}"])


def latex_macros(values: dict[str, object], digits: int = 4) -> str:
    """A command for each value; names have letters only."""
    for name in values:
        if not name.isalpha():
            raise ValueError(f"a command has letters only: {name}")
    text = lambda v: latex_text(v) if isinstance(v, str) else number_text(v, digits)
    return "\n".join(rf"\newcommand{{\{n}}}{{{text(v)}}}" for n, v in values.items())
