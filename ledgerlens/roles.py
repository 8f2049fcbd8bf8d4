"""Column roles: which column of a table plays which part."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class HeaderRoles:
    """Columns of the header (order) table."""

    key: str
    number: str
    country: str
    ts: str
    claimed: str
    recommended: str
    agreed: str
    residual: str
    group: str
    kind: str
    trade: str
    company: str
    line_count: str = "line_count"
    test_word: str = "test"
    pro_forma: tuple[float, float] = (0.01, 1)
    high_value: float = 50000
    not_counted_as_null: list[str] = field(default_factory=list)

    @property
    def amounts(self) -> list[str]:
        return [self.agreed, self.recommended, self.claimed]


@dataclass(frozen=True)
class LineRoles:
    """Columns of the line (position) table."""

    key: str
    id: str
    text: str
    claimed: str
    agreed: str
    quantity: str
    quantity_agreed: str
    unit_price: str
    unit_price_agreed: str
    is_discount: str = "is_discount"
    is_plausible: str = "is_plausible"
    not_counted_as_null: list[str] = field(default_factory=list)

    @property
    def sign_pairs(self) -> list[tuple[str, str]]:
        return [
            (self.unit_price, self.unit_price_agreed),
            (self.claimed, self.agreed),
        ]
