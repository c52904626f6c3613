"""The service: requests as Python methods with envelopes, and over HTTP."""
