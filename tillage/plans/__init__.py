"""Building blocks shared by many operators: row ids, ranks, quantiles, skew-safe lookups, recipes."""
