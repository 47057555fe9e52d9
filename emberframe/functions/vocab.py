"""Standard variable names."""

from __future__ import annotations

# The standard names, which are the column names of every dataset.
STANDARD_NAMES = """
air_density air_temperature alpha beta building_ratio_fire_resistant building_ratio_structure_wood_bare building_ratio_structure_wood_mortar
building_length_separation building_length_side canopy_density_bulk canopy_height canopy_height_bottom canopy_height_top direction
fire_arrival_time fire_burn_severity fuel_class fuel_chaparral_flag fuel_cover fuel_density fuel_density_bulk fuel_density_dead
fuel_density_live fuel_fraction_consumed_flame_zone fuel_heat_content fuel_height fuel_load_dead_ratio fuel_load_fine fuel_load_fine_dead
fuel_load_fine_live fuel_load_dry_1h fuel_load_dry_10h fuel_load_dry_100h fuel_load_dry_1000h fuel_load_dry_live fuel_load_dry_live_herb
fuel_load_dry_live_woody fuel_load_dry_total fuel_mineral_content_effective fuel_mineral_content_total fuel_moisture_content
fuel_moisture_content_1h fuel_moisture_content_10h fuel_moisture_content_100h fuel_moisture_content_1000h fuel_moisture_content_dead
fuel_moisture_content_elevated_dead fuel_moisture_content_fine_dead fuel_moisture_content_live fuel_moisture_extinction
fuel_roughness_height fuel_sfireburnup_consumption_cst fuel_surface_area_volume_ratio fuel_surface_area_volume_ratio_dead
fuel_surface_area_volume_ratio_dead_1h fuel_surface_area_volume_ratio_live fuel_surface_area_volume_ratio_live_herb
fuel_surface_area_volume_ratio_live_woody fuel_temperature_ignition fuel_thermal_conductivity fuel_tree_class fuel_wind_height
fuel_wind_reduction_factor ignition_length latitude length longitude magnitude normal_spread_dir_x normal_spread_dir_y rate_of_spread
ravg_canopy_cover_loss ravg_composite_burn_index_severity ravg_live_basal_area_loss relative_humidity solar_radiation slope_angle
temperature time wind_direction wind_gust wind_speed wind_speed_u wind_speed_v wind_speed_w x y z
""".split()  # noqa: SIM905


def check_names(columns: list[str]) -> list[str]:
    """Those of columns that are not standard names."""
    known = set(STANDARD_NAMES)
    return [c for c in columns if c not in known]
