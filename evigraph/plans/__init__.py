"""Plans that put operators together: providers, the engine, registered queries."""
