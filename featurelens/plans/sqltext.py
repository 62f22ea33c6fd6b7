"""Small pieces shared by the oracle texts."""


def word(key: str, n: int = 0) -> str:
    """The n-th 60-bit word of an md5 hex key as bigint."""
    if n > 1:
        key, n = f"md5({key} || '-{n}')", 0
    return f"(('0x' || substr({key}, {15 * n + 1}, 15))::BIGINT)"


def uniform(key: str, n: int = 0) -> str:
    return f"(({word(key, n)} >> 8) / {1 << 52}.0::DOUBLE)"


def splits_sql(source: str, heldout: float, seed: int = 0, tune: float | None = None) -> str:
    """CTEs ending in ``slots(subject_id, split)``."""
    tune = heldout / 2 if tune is None else tune
    return f"""slot_order AS (
      SELECT subject_id,
        row_number() OVER (ORDER BY md5('{seed}-' || subject_id), subject_id) - 1 AS slot,
        greatest(2, round_even({heldout}::DOUBLE * count(*) OVER (), 0)) AS held
      FROM (SELECT DISTINCT subject_id FROM {source})),
    slots AS (
      SELECT subject_id, CASE
        WHEN slot < least(held - 1, greatest(1, round_even(held * {tune}::DOUBLE / {heldout}::DOUBLE, 0)))
          THEN 'tune'
        WHEN slot < held THEN 'test' ELSE 'train' END AS split
      FROM slot_order)"""
