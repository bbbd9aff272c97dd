"""DuckDB SQL builders for the home-estimation oracles (brute force on purpose)."""

from __future__ import annotations

from geotrail.plans.oracle_prelude import hav


def cands_sql(net: str = "net", name: str = "cand", max_posts: int | None = None) -> str:
    upper = f" AND COUNT(DISTINCT media_id) < {max_posts}" if max_posts else ""
    return f"""
{name} AS (
  SELECT user_name, media_id, followers_count, lat, lon, concat_ws(',', place_name, country_code) AS place_location
  FROM {net} WHERE lat IS NOT NULL AND place_type = 'city' AND user_id IN (
    SELECT user_id FROM {net} WHERE lat IS NOT NULL GROUP BY user_id
    HAVING COUNT(DISTINCT media_id) >= 3{upper}))"""


def medoid_sql(rows: str, key: str, lat: str, lon: str, label: str, w: str | None, out: str,
               extra_keys: tuple[str, ...] = ()) -> str:
    """CTE ``out``(keys, lat, lon, label) = per key medoid of the located rows."""
    ks = ", ".join((*extra_keys, key))
    on = " AND ".join(f"c.{k} = p.{k}" for k in (*extra_keys, key))
    wexpr = f"sum({w})" if w else "COUNT(*)"
    return f"""
{out}_pts AS (
  SELECT {ks}, {lat} AS lat, {lon} AS lon, {wexpr} AS w, COUNT(*) AS m, min({label}) AS label
  FROM {rows} WHERE {lat} IS NOT NULL AND {lon} IS NOT NULL GROUP BY {ks}, {lat}, {lon}),
{out}_cost AS (
  SELECT {", ".join("c." + k for k in (*extra_keys, key))}, c.lat, c.lon, c.label,
         round(sum(p.w * {hav("p.lon", "p.lat", "c.lon", "c.lat")}), 6) AS cost
  FROM {out}_pts c JOIN {out}_pts p ON {on}
  GROUP BY {", ".join("c." + k for k in (*extra_keys, key))}, c.lat, c.lon, c.label),
{out} AS (
  SELECT {ks}, lat, lon, label FROM (
    SELECT *, row_number() OVER (PARTITION BY {ks} ORDER BY cost, lat, lon, label) AS rn FROM {out}_cost)
  WHERE rn = 1)"""


def inferred_dispersion_sql(rows: str, key: str, lat: str, lon: str, med: str, out: str,
                            extra_keys: tuple[str, ...] = (), tiebreak: str = "rowid_") -> str:
    """CTE ``out``(keys, dispersion): median distance of the located rows to the
    medoid, one row at the medoid left out; 0.0 when nothing is left."""
    ks = ", ".join((*extra_keys, key))
    on = " AND ".join(f"r.{k} = h.{k}" for k in (*extra_keys, key))
    return f"""
{out}_rows AS (
  SELECT {", ".join("r." + k for k in (*extra_keys, key))}, {hav(f"r.{lon}", f"r.{lat}", "h.lon", "h.lat")} AS d,
         (r.{lat} = h.lat AND r.{lon} = h.lon) AS at_home,
         row_number() OVER (PARTITION BY {", ".join("r." + k for k in (*extra_keys, key))},
                            (r.{lat} = h.lat AND r.{lon} = h.lon) ORDER BY r.{tiebreak}) AS rn
  FROM {rows} r JOIN {med} h ON {on} WHERE r.{lat} IS NOT NULL AND r.{lon} IS NOT NULL),
{out} AS (
  SELECT h.*, coalesce(x.dispersion, 0.0) AS dispersion FROM {med} h LEFT JOIN (
    SELECT {ks}, median(d) AS dispersion FROM {out}_rows WHERE NOT (at_home AND rn = 1) GROUP BY {ks}) x
  USING ({ks}))"""


def round_sql(edges: str, prev: str, out: str, weighted: bool, fold: bool = False,
              max_disp: float = 100.0) -> str:
    """One propagation round: CTE ``out``(fold?, user_name, lat, lon, user_location)."""
    fk = ("fold",) if fold else ()
    fsel = "e.fold, " if fold else ""
    fon_t = "t.fold = e.fold AND " if fold else ""
    fon_s = "s.fold = e.fold AND " if fold else ""
    fcols = "fold, " if fold else ""
    ks = ", ".join((*fk, "source"))
    return f"""
{out}_adj AS (
  SELECT {fsel}e.source, e.target, e.weight, t.lat AS tlat, t.lon AS tlon, t.user_location AS tloc,
         s.lat AS slat, s.lon AS slon, s.user_location AS sloc
  FROM {edges} e LEFT JOIN {prev} t ON {fon_t}t.user_name = e.target
                 LEFT JOIN {prev} s ON {fon_s}s.user_name = e.source),
{out}_known AS (
  SELECT {ks}, min(slat) AS lat, min(slon) AS lon, min(sloc) AS label,
         coalesce(median(CASE WHEN tlat IS NOT NULL AND tlon IS NOT NULL
                               THEN {hav("tlon", "tlat", "slon", "slat")} END), 0.0) AS dispersion
  FROM {out}_adj WHERE slat IS NOT NULL AND slon IS NOT NULL GROUP BY {ks}),
{out}_unk AS (SELECT * FROM {out}_adj WHERE NOT (slat IS NOT NULL AND slon IS NOT NULL)),
{medoid_sql(f"{out}_unk", "source", "tlat", "tlon", "tloc", "weight" if weighted else None, f"{out}_med", fk).lstrip()},
{inferred_dispersion_sql(f"{out}_unk", "source", "tlat", "tlon", f"{out}_med", f"{out}_disp", fk, "target").lstrip()},
{out} AS (
  SELECT {fcols}source AS user_name, lat, lon, label AS user_location FROM (
    SELECT {ks}, lat, lon, label, dispersion FROM {out}_known
    UNION ALL SELECT {ks}, lat, lon, label, dispersion FROM {out}_disp)
  WHERE dispersion < {max_disp} AND lat IS NOT NULL AND lon IS NOT NULL)"""
