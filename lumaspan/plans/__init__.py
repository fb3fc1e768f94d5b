"""Named queries over the dataset tables, one module per area."""

from lumaspan.plans import changes, columns, evidence, neardup, pool, quality, relational, states, subscriptions, text

MODULES = [changes, columns, evidence, neardup, relational, text, states, quality, pool, subscriptions]
