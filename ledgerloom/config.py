"""Settings of a run, with every step's switch; from_dict() takes what a YAML or JSON file holds."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass


@dataclass
class Blocks:
    do: bool = True


@dataclass
class Txos:
    do: bool = False
    add_script: bool = False
    create_index: bool = True
    safe_mode: bool = False


@dataclass
class Switch:
    do: bool = False


@dataclass
class Alias:
    do: bool = False
    insert_alias: bool = False
    block_step: int = 100
    exclude_coinjoin: bool = True
    common_input_ownership: bool = True
    deposit_address: bool = False
    deposit_address_min_num_inputs: int = 25
    change_address: bool = True
    round_output_value: bool = True
    round_output_value_x: float = 1
    round_output_value_j: int = 1
    market_price: str = ""
    block_dates: str = ""
    force_merge_inputs: bool = True


@dataclass
class Edges:
    do: bool = False
    block_step: int = 100
    exclude_coinjoin: bool = True
    exclude_colored_coin: bool = True
    only_one_per_position: bool = True


@dataclass
class Undirected:
    do: bool = False
    block_step: int = 100


@dataclass
class Features:
    do: bool = False
    block_step: int = 100
    do_cluster_features: bool = False


@dataclass
class Config:
    folder: str = ""
    start: int = 0
    end: int = 300_000
    db: dict = field(default_factory=dict)
    blocks: Blocks = field(default_factory=Blocks)
    txos: Txos = field(default_factory=Txos)
    coinjoin: Switch = field(default_factory=Switch)
    colored_coins: Switch = field(default_factory=Switch)
    alias: Alias = field(default_factory=Alias)
    transaction_edges: Edges = field(default_factory=Edges)
    undirected_transaction_edges: Undirected = field(default_factory=Undirected)
    features: Features = field(default_factory=Features)

    @classmethod
    def from_dict(cls, found: dict) -> Config:
        def make(kind, values):
            known = {f.name: f for f in fields(kind)}
            if unknown := set(values) - set(known):
                raise ValueError(f"unknown settings: {sorted(unknown)}")
            default = kind()
            return kind(**{k: make(type(getattr(default, k)), v) if is_dataclass(getattr(default, k)) else v for k, v in values.items()})

        return make(cls, found)

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        with open(path) as f:
            return cls.from_dict(yaml.safe_load(f))
