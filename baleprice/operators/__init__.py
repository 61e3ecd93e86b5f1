"""DataFrame -> DataFrame operators: cleaning, lookups, features, rules, scoring, reports, training."""
