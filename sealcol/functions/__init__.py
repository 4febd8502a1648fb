"""Column functions: key derivation, envelopes, canonical values, normal forms."""
