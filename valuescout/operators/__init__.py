"""DataFrame -> DataFrame operators; lazy unless a docstring says otherwise."""
