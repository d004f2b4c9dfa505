"""DataFrame operators. Statistic-bearing ones come as a fit / apply pair."""
