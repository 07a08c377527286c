"""Building blocks of the check queries: independent SQL for the greedy walks, by recursion over ranks."""

from __future__ import annotations

from foliospark.plans.fixtures import CTE

INTER = ("greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1))")
AREA_K = "(k.x2 - k.x1) * (k.y2 - k.y1)"
AREA_B = "(b.x2 - b.x1) * (b.y2 - b.y1)"
IOU_ABOVE = f"100 * ({INTER}) > 45 * ({AREA_K} + {AREA_B} - {INTER})"
IOU_REACHES = f"({INTER}) > 0 AND 100 * ({INTER}) >= 45 * ({AREA_K} + {AREA_B} - {INTER})"
CONTAINED = f"10 * ({INTER}) > 7 * least({AREA_K}, {AREA_B})"


def views(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTE[n] for n in names)


def struct(alias: str, cols: list[str]) -> str:
    return "{" + ", ".join(f"'{c}': {alias}.{c}" for c in cols) + "}"


def greedy(name: str, source: str, key: str, cols: list[str], order: str, clash: str, pinned: str = "false") -> str:
    """CTEs leaving in ``name`` the rows of ``source`` the greedy walk keeps."""
    clash_b = clash.replace("b.", "r.")
    return f"""{name}_r AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rk FROM {source}),
{name}_f AS (
  SELECT {key}, rk, [{struct('r', cols)}] AS kept FROM {name}_r r WHERE rk = 1
  UNION ALL
  SELECT r.{key}, r.rk,
         CASE WHEN NOT ({pinned}) AND len(list_filter(f.kept, lambda k: {clash_b})) > 0 THEN f.kept
              ELSE list_append(f.kept, {struct('r', cols)}) END
  FROM {name}_f f JOIN {name}_r r ON r.{key} = f.{key} AND r.rk = f.rk + 1),
{name}_l AS (
  SELECT {key}, kept FROM {name}_f QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY rk DESC) = 1),
{name}_u AS (SELECT {key}, unnest(kept) AS k FROM {name}_l),
{name} AS (SELECT {key}, {', '.join(f'k.{c} AS {c}' for c in cols)} FROM {name}_u)"""


def row_walk(name: str, source: str, key: str, cols: list[str], order: str, rtl: bool = False) -> str:
    """CTEs leaving in ``name`` the rows with ``row_no`` and ``reading_order``."""
    side = "-k.x1" if rtl else "k.x1"
    over = ("10 * (least(f.heads[i].y2, r.y2) - greatest(f.heads[i].y1, r.y1)) > "
            "4 * least(f.heads[i].y2 - f.heads[i].y1, r.y2 - r.y1)")
    item = struct("r", cols)[:-1]
    return f"""{name}_r AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rk FROM {source}),
{name}_f AS (
  SELECT {key}, rk, [{{'y1': r.y1, 'y2': r.y2}}] AS heads, [{item}, 'rk': r.rk, 'row_no': CAST(1 AS BIGINT)}}] AS done
  FROM {name}_r r WHERE rk = 1
  UNION ALL
  SELECT {key}, rk, CASE WHEN hit_no IS NULL THEN list_append(heads, {{'y1': y1, 'y2': y2}}) ELSE heads END,
         list_append(done, {struct('s', cols)[:-1]}, 'rk': s.rk, 'row_no': CAST(coalesce(hit_no, len(heads) + 1) AS BIGINT)}})
  FROM (SELECT r.*, f.heads, f.done,
               list_filter(range(1, len(f.heads) + 1), lambda i: {over})[1] AS hit_no
        FROM {name}_f f JOIN {name}_r r ON r.{key} = f.{key} AND r.rk = f.rk + 1) s),
{name}_l AS (
  SELECT {key}, done FROM {name}_f QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY rk DESC) = 1),
{name}_u AS (SELECT {key}, unnest(done) AS k FROM {name}_l),
{name} AS (
  SELECT {key}, {', '.join(f'k.{c} AS {c}' for c in cols)}, k.row_no AS row_no,
         row_number() OVER (PARTITION BY {key} ORDER BY k.row_no, {side}, k.rk) AS reading_order FROM {name}_u)"""


def r6(sql: str, digits: int = 6) -> str:
    """Rounded off the ties, without negative zero."""
    value = f"round(({sql}) + 1e-9::DOUBLE, {digits})"
    return f"(CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE {value} END)"
