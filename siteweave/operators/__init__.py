"""Operators on call tables: joins on loci, ranks, statistics, resampling, models and gates."""
