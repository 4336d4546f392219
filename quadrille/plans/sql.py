"""The two dialects in which the relational queries are written once: Spark's and that of the engine that checks them."""

from __future__ import annotations


class Spark:
    @staticmethod
    def div(a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    @staticmethod
    def xor(a: str, b: str) -> str:
        return f"(({a}) ^ ({b}))"

    @staticmethod
    def numbers(first: int, last: int, name: str) -> str:
        return f"(SELECT explode(sequence({first}, {last})) AS {name})"

    PIXELS = "SELECT vec_id, posexplode(embedding) AS (pos, e) FROM embeddings"


class Check:
    @staticmethod
    def div(a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    @staticmethod
    def xor(a: str, b: str) -> str:
        return f"xor({a}, {b})"

    @staticmethod
    def numbers(first: int, last: int, name: str) -> str:
        return f"(SELECT unnest(range({first}, {last + 1})) AS {name})"

    PIXELS = "SELECT vec_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS e FROM embeddings"
