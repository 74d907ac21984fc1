"""The composed queries: from landed sheets and service answers to model tables, reports and model runs."""
