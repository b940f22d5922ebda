"""DataFrame-to-DataFrame operators. All are lazy except validation in strict mode and model fitting."""
