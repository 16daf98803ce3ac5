"""Looking up datasources, domains and profiles, and filling in inherited settings."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from pathlib import Path

from ..errors import ConfigurationError
from ..functions.normalize import Strategy
from .settings import CompareMode
from .spec import Datasource, Domain, Profile, SideSpec, blank, valid_name


@dataclass(frozen=True)
class Defaults:
    """Settings that apply where neither the profile nor its domain says otherwise."""

    strategy: Strategy = Strategy.LENIENT
    mode: CompareMode = CompareMode.MISMATCH_DETAILS
    query_dir: str | Path = "queries"
    batch_size: int = 1000


class Catalog:
    """Plain lookup tables of specs; profiles come out with all inheritance applied."""

    def __init__(
        self,
        datasources: Iterable[Datasource] = (),
        domains: Iterable[Domain] = (),
        defaults: Defaults = Defaults(),
    ):
        self.defaults = defaults
        self.datasources: dict[str, Datasource] = {}
        self.domains: dict[str, Domain] = {}
        for source in datasources:
            self.add_datasource(source)
        for domain in domains:
            self.add_domain(domain)

    def add_datasource(self, source: Datasource) -> None:
        known = self.datasources.get(source.name)
        if known is not None and known.kind is not source.kind:
            raise ConfigurationError(f"Datasource [{source.name}] is already registered as {known.kind.value}")
        owner = self._by_schema(source.schema)
        if owner is not None and owner.name != source.name:
            raise ConfigurationError(f"Schema [{source.schema}] is already bound to datasource [{owner.name}]")
        self.datasources[source.name] = source

    def add_domain(self, domain: Domain) -> None:
        self.domains[domain.id] = domain

    def _by_schema(self, schema: str | None) -> Datasource | None:
        if blank(schema):
            return None
        return next((d for d in self.datasources.values() if d.schema == schema), None)

    def datasource(self, ref: str) -> Datasource:
        """By name, else by the schema it is bound to."""
        found = self.datasources.get(ref.strip()) or self._by_schema(ref.strip())
        if found is None:
            raise ConfigurationError(f"Unknown datasource [{ref}]; known: {sorted(self.datasources)}")
        return found

    def domain(self, domain_id: str) -> Domain:
        if domain_id not in self.domains:
            raise ConfigurationError(f"Unknown domain: {domain_id}")
        return self.domains[domain_id]

    def profile(self, domain_id: str, profile_id: str) -> Profile:
        """The profile with every setting resolved: its own, else the domain's, else the default."""
        domain = self.domain(domain_id)
        if profile_id not in domain.profiles:
            raise ConfigurationError(f"Unknown profile: {domain_id}.{profile_id}")
        valid_name("profile", profile_id)
        profile = domain.profiles[profile_id]
        first = lambda *values: next((v for v in values if v is not None and v != ""), None)
        key = first(profile.key, profile.source.key, profile.target.key)
        identifiers = first(profile.identifiers, profile.source.identifiers, profile.target.identifiers)
        sides = {
            "source": self._side(profile.source, first(profile.source_datasource, domain.source_datasource)),
            "target": self._side(profile.target, first(profile.target_datasource, domain.target_datasource)),
        }
        batch_size = first(profile.batch_size, domain.batch_size, self.defaults.batch_size)
        sides = {
            role: replace(side.patched(key=key, identifiers=identifiers), batch_size=first(side.batch_size, batch_size))
            for role, side in sides.items()
        }
        return replace(
            profile,
            **sides,
            key=key,
            identifiers=identifiers,
            domain_id=domain_id,
            profile_id=profile_id,
            settings=profile.settings.inherit(domain.settings, self.defaults.mode),
            strategy=first(profile.strategy, domain.strategy, self.defaults.strategy),
            query_dir=first(profile.query_dir, domain.query_dir, self.defaults.query_dir),
            batch_size=batch_size,
        )

    def _side(self, side: SideSpec, inherited: str | None) -> SideSpec:
        ref = side.datasource if not blank(side.datasource) else inherited
        if blank(ref):
            return side
        source = self.datasource(ref)
        return replace(
            side,
            datasource=source.name,
            kind=side.kind or source.kind,
            schema=source.schema if blank(side.schema) else side.schema,
        )

    def profiles(self) -> list[Profile]:
        return [self.profile(d.id, p) for d in self.domains.values() for p in d.profiles]

    def resolve_profile(self, ref: str | None, domain: str | None = None) -> Profile:
        """``domain.profile``, or a profile id that is unique, or an id inside the hinted domain."""
        wanted, within = (ref or "").strip(), (domain or "").strip()
        if not wanted:
            raise ConfigurationError("Name the profile to run")
        named = wanted.split(".", 1)
        if len(named) == 2 and all(named):
            if within and within.casefold() != named[0].casefold():
                raise ConfigurationError(f"Profile {wanted} was asked for within another domain, {within}")
            return self.profile(*named)
        if within:
            return self.profile(within, wanted)
        holders = [(d.id, p) for d in self.domains.values() for p in d.profiles if p.casefold() == wanted.casefold()]
        if len(holders) != 1:
            which = ", ".join(d for d, _ in holders) or "no domain"
            raise ConfigurationError(f"Profile {wanted} has to be found in one domain, it is in {which}")
        return self.profile(*holders[0])
